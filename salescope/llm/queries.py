"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import bpe, chat, decontam, iblt, licenses, lm, negatives, periodic, simhash, token_counts, toxicity, urls, warc
from salescope.llm.common import crc_mod, read


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; operators take the file's content, whatever its place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that contaminates it."""
    found = decontam.matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    one = found.where("size(matches) > 0").select("doc_id", F.explode("matches").alias("m"))
    return one.select("doc_id", "m.item_id", F.round("m.coverage", 6).alias("coverage"), F.size("m.tiles").alias("n_tiles"),
                      F.array_max("m.tiles.words").alias("longest_tile"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _conversation_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads segments back, ordered by conversation; holds one conversation's running hashes at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, state = None, None

    def row():
        return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for frame in batches:
        out = []
        for conv, segment, start, end in zip(frame.conv_id, frame.segment, frame.loss_start, frame.loss_end):
            conv = None if pd.isna(conv) else int(conv)
            if key != (conv,):
                if key is not None:
                    out.append(row())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in chat.parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if not pd.isna(end):
                loss = chat.unescape(segment[int(start):int(end)])
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += len(segment)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if key is not None:
        yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))).alias("record"))
    hard = "</s>[INST] ok [/INST]"
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast(rows.schema["turn"].dataType).alias("turn"),
                                F.lit(json.dumps({"prompt": hard, "completion": hard})).alias("record"))
    turns = chat.canonical(rows.union(one))
    rank = F.struct("turn", "place", "role", F.coalesce("text", F.lit("")).alias("text"))
    segments = chat.format_turns(turns.withColumn("rank", rank))
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "rank").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInPandas(_conversation_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("blocks.label"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    scored, model = lm.fit_and_score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iblt.successors(read(spark, sf_dir, "documents").select("doc_id", "text"), digested=True)
    size = F.char_length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", iblt.digests(F.col("edited")).alias("other"), "next")
    own, other, following = F.col("own"), F.col("other"), F.col("next")
    return rows.select("doc_id", "n_chars", "edited_sha256", iblt.fingerprint(own).alias("fingerprint"), iblt.fingerprint(other).alias("edited_fingerprint"),
                       iblt.likeness(own, other).alias("near_edited"), iblt.likeness(own, following).alias("near_next"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_matched")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count(docs, token_counts.load(tokenizer("piece_bpe_32k.model")), budget=4096)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 4096).alias("over_limit"), "kept_chars")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion and the metadata record of every page's response."""
    derived = warc.derive(warc.responses(read(spark, sf_dir, "pages")))
    one = derived.select("page_id", F.explode("derived").alias("d")).select("page_id", "d.*")
    return one.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bpe.load(tokenizer("word_bpe_49k.json"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, source)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def edited_words(text: Column, doc_id: Column) -> Column:
    """One in ten texts (crc32 of the id divisible by 10) with its words repeating periodically from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & F.when(h % 10 == 0, n > 0), made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", edited_words(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    rows = found.select("doc_id", "runs", "collapsed", periodic.strongest(F.col("runs")).alias("best"))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                       F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The rules of the URL query.
URL_RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)

#: The small labelled table that the URL query learns from (invented addresses).
BLOCKED_URLS = """
http://casino-royal.test/en/2201
https://www.lucky-casino.test/en/881?ref=1
http://win-big-casino.test/de/12/
https://m.casino-games.test/de/8801.html
https://blog.online-poker.test/en/450
http://poker-bets.test/es/77#top
https://sports-bets.test/fr/3120
http://blog.best-bets.test/fr/64?page=2
https://m.freebets.test/en/771
http://www.betting-tips.test/de/9034.html
https://cheap-meds.test/en/511?utm_source=feed
http://blog.pills-online.test/en/1702/
https://www.discount-pills.test/es/28?page=2
http://m.cheap-viagra.test/fr/610
https://pharmacy-cheap.test/de/4003.html
http://diet-pills.test/en/9
https://www.ads-server.test/en/3388#top
http://track-ads.test/es/1456/
https://m.banner-ads.test/de/700
http://blog.click-track.test/fr/99?page=2&ref=x
https://tracker.ads.test/en/3105
http://popup-ads.test/en/5920.html
https://spam-links.test/de/41
http://www.link-farm.test/en/200?utm_source=feed
https://blog.seo-farm.test/fr/3316
http://m.spam-mail.test/es/87/
https://content-farm.test/en/5512#top
http://bulk-spam.test/fr/1290.html
https://www.payday-loans.test/en/6021
http://blog.quick-cash.test/de/35?page=2
https://m.free-money.test/en/4417/
http://win-prizes.test/es/818
https://free-iphone.test/fr/2640?ref=x
http://www.xxx-videos.test/de/44
https://blog.hot-singles.test/en/7309.html
http://m.adult-cams.test/es/156#top
https://adult-dating.test/en/991/
http://crack-keys.test/de/3745
https://www.free-warez.test/fr/80?utm_source=feed
http://blog.fake-watches.test/en/5128
https://m.cheap-replica.test/es/613.html
http://malware-scan.test/en/2007/
https://www.phish-login.test/de/431
http://blog.crypto-doubler.test/fr/1988#top
https://miracle-cure.test/en/72?page=2&ref=x
http://m.get-rich.test/es/6650
https://cheap-followers.test/en/3042.html
http://www.free-spins.test/de/518/
""".split()
ALLOWED_URLS = """
http://city-library.test/en/1120
https://www.river-museum.test/en/4021
https://north-school.test/de/5120.html
http://blog.mountain-walks.test/en/778/
https://garden-notes.test/fr/1203?page=2
https://m.daily-herald.test/en/2311#top
http://weather-report.test/es/390
https://www.old-maps.test/en/99.html
http://blog.kitchen-table.test/de/620
https://science-review.test/en/3390?utm_source=feed
http://m.train-times.test/fr/881
https://history-society.test/es/4410/
http://www.botany.test/en/6120
https://open-lectures.test/en/7001?page=2&ref=x
http://blog.shortstories.test/fr/318#top
https://chess-club.test/de/55
https://m.village-news.test/es/6203.html
http://harbour-office.test/en/305
https://www.physics-notes.test/en/1777
http://theatre.test/de/2
https://blog.bicycle-repair.test/en/93
https://music-archive.test/fr/2280/
http://stone-bridge.test/en/4456?utm_source=feed
https://m.language-course.test/es/31
http://www.birdwatch.test/de/8123
https://public-health.test/en/8809
http://blog.thethread.test/en/6509/
https://northern-lights.test/fr/117?page=2
http://tennis-results.test/es/1999.html
https://www.thirtythree.test/en/2042#top
http://m.the-other-station.test/de/640
https://astronomy.test/en/5005
http://recipe-book.test/fr/12
https://blog.winter-garden.test/en/3?ref=x
http://www.fishing-village.test/es/722
https://documentation.test/en/472.html
http://country-doctor.test/de/14
https://m.star-charts.test/en/9080/
http://painting-class.test/fr/471
https://blog.thinkers.test/es/2650
http://www.city-council.test/en/5301
https://translation.test/de/3108?page=2
http://the-nation.test/en/8231
https://wood-workshop.test/fr/59#top
http://m.national-park.test/es/940
https://www.theory.test/en/1410.html
http://geology.test/de/7
https://blog.evening-post.test/en/3999
""".split()


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]
    model = urls.fit(spark.createDataFrame(table, "url string, blocked int").coalesce(1))
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_simhash_dedup, op3_chat_format, op4_license_scan, op5_lm_scores, op6_iblt_fingerprints, op7_toxicity, op8_token_counts, op9_warc_derivatives, op10_bpe,
                                    op11_hard_negatives, op12_periodic_runs, op13_url_filter)}


#: op3: the turns in order, then hashes of what the contract names; the escape character is doubled and one more
#: character goes behind the first sign of each control string.
_ESCAPED = "length({0}) + (length({0}) - length(replace({0}, chr(9243), ''))) + len(regexp_extract_all({0}, '" + "|".join(
    chat.re.escape(c).replace("'", "''") for c in chat.CONTROLS) + "'))"

OP3_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, 0 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, place, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, place, role, text), '')) AS loss_sha256,
  CAST(sum({_ESCAPED.format('role')} + (length(role) - length(replace(role, chr(10), ''))) + {_ESCAPED.format('text')} + {len(chat.TURN) + len(chat.STOP) + 2}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


#: op11: every anchor against every row, component by component.
OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op11_hard_negatives": OP11_SQL}
