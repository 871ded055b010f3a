import random
import re

from salescope.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text):
    w = brute_words(text)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    blocks = set()
    for line, t in enumerate((text or "").split("\n")):
        own = set(brute_words(t))
        for label, template in licenses.TEMPLATES:
            want = set(brute_words(template))
            if len(own & want) >= licenses.THRESHOLD * len(want) - 1e-9:
                blocks.add((line, label, len(own & want) / len(want)))
    at = [p[0] for p in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), sorted({p[1] for p in places}), sorted(blocks)


ODD = [None, "", "\n\n", "under the MIT license under the mit license", "Under-the\nMIT, license!", "cc by nc cc by nc", "released under the MIT license",
       "Released UNDER the\tlicense", "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "apache license version 22",
       "éunder the mit license", "word " * 5000 + "under the mit license", "Licensed under the Apache License, Version 2.0."]


def test_odd_rows(spark):
    rnd = random.Random(4)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()]
    texts = ODD + ["\n".join(" ".join(rnd.sample(pool, 40)) for _ in range(3)) for _ in range(30)]
    for _, t in licenses.TEMPLATES:  # one word missing, one replaced, shuffled
        w = t.split()
        k = rnd.randrange(len(w))
        texts += [" ".join(w[:k] + w[k + 1:]), " ".join(w[:k] + ["other"] + w[k + 1:]), " ".join(rnd.sample(w, len(w)) + ["and", "more"])]
    df = spark.createDataFrame([(t, 1) for t in texts] + [("", 2)], "text string, N_WORDS int")
    got = licenses.scan(df)
    assert got.columns == ["text", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
    for r in got.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, sorted({tuple(b) for b in r.blocks})) == brute(r.text), r.text
    assert licenses.scan(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n, places, first, last, base, blocks = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (n, places, first, last, ",".join(base))
        assert g.labels == ",".join(sorted({*base, *(b[1] for b in blocks)}))
        assert g.score == (1.0 if places else max((b[2] for b in blocks), default=0.0))


def test_wrapped_notices(spark):
    mit = ("Copyright (c) someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction")
    apache = (" * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n"
              " *     http://www.apache.org/licenses/LICENSE-2.0\n */")
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General\n# Public License as published by")
    short = "text\nLicensed under CC\nBY-NC 4.0. More text"
    line = "Released under the MIT License."
    texts = [(mit, ["mit"], [2]), (apache, ["apache-2"], [0]), (gpl, ["gpl"], [0]), (short, ["cc-by-nc"], [1]),
             (line + "\nReleased under\nthe MIT License.\n" + line, ["mit"] * 3, [0, 1, 3]),
             ("Licensed under CC\n" + "and many other words " * 3 + "\nBY-NC 4.0.", [], []),
             (gpl.replace("redistribute", "sell").replace("modify", "change").replace("terms", "eyes"), [], [])]
    for _, t in licenses.TEMPLATES:  # one word a line
        texts.append(("\n".join(t.split()), None, [0]))
    got = {r.i: r.blocks for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "i int, text string")).collect()}
    for i, (t, labels, lines) in enumerate(texts):
        blocks = got[i]
        if labels is None:
            assert any(b.label == licenses.TEMPLATES[i - 7][0] and b.containment == 1.0 for b in blocks), t
        else:
            assert ([b.label for b in blocks], [b.line for b in blocks]) == (labels, lines), t
