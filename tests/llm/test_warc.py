import base64
import hashlib
import html
import re
from html.parser import HTMLParser

from salescope.llm import queries, warc

SF = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    """Brute force: the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = tag
            self.out.append(" ")
        elif not self.skip and tag in warc._BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = None if tag == self.skip else self.skip
        elif tag in warc._BLOCKS:
            self.out.append("\n")

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s", " ", data))

    def handle_entityref(self, name):
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(html.unescape(f"&#{name};"))


def brute(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "\n".join(t for line in "".join(p.out).split("\n") if (t := " ".join(line.split())))


def test_plain_text_equals_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert pages
    for r in pages:
        assert warc.plain_text(r.html.encode()) == brute(r.html), r.page_id


def test_plain_text_of_odd_pages():
    cases = {"": "", "a<b>c</b>d": "acd", "<p>a<p>b": "a\nb", "<!-- <p>x</p> -->y": "y", "<!-- open": "", "<script>var a='<p>';</script>z<style>q": "z",
             "<a title=\"x>y\">k</a>": "k", "a &amp;lt; &eacute;&#233; b": "a &lt; éé b", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<p title='open>t": "t", "a<br/>b\n\nc": "a\nb c"}
    for page, text in cases.items():
        assert warc.plain_text(page.encode()) == text, page


def test_records_are_linked_and_digested(spark):
    df = spark.createDataFrame([(1, "http://a/é", "<title>T &amp; U</title><p>héllo <a href='x'>w</a>", "k"), (2, None, None, "k"), (None, "u", "x" * 200000, "k"), (1, "http://a/é", "<title>T &amp; U</title><p>héllo <a href='x'>w</a>", "k")],
                               "page_id long, url string, html string, derived string")
    made = warc.derive(warc.responses(df)).collect()
    assert len(made) == 4 and all(r.failure is None for r in made)
    for r in made:
        source, block = warc.parse(r.record.encode())
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert source["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        assert [d.record_type for d in r.derived] == ["conversion", "metadata"]
        for d in r.derived:
            fields, body = warc.parse(d.record.encode())
            assert fields["warc-refers-to"] == d.refers_to == source["warc-record-id"]
            assert fields["warc-target-uri"] == source["warc-target-uri"] and fields["warc-date"] == source["warc-date"]
            assert fields["warc-source-payload-digest"] == source["warc-payload-digest"]
            assert d.block_digest == fields["warc-block-digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
            assert d.content_length == len(body) and fields["warc-record-id"] == d.record_id
        about = dict(x.split(": ", 1) for x in r.derived[1].record.split("\r\n\r\n", 1)[1].splitlines())
        assert about["conversion"] == r.derived[0].record_id and about["source-digest-matches"] == "true"
        assert about["source-header-content-length"] == str(len(payload))
    one = next(r for r in made if r.page_id == 1)
    assert one.derived[0].record.endswith("\r\n\r\nT & U\nhéllo w") and "title: T & U\r\n" in one.derived[1].record
    assert len({r.derived[0].record_id for r in made}) == 3


def test_broken_records_fail_alone(spark):
    good = warc.response("u", b"<p>x", "1")
    bad = good.replace(b"<p>x", b"<p>y")
    df = spark.createDataFrame([(0, good.decode()), (1, None), (2, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (3, bad.decode()), (4, good.decode().replace("response\r\n", "request\r\n", 1))], "i int, record string")
    got = {r.i: r for r in warc.derive(df).collect()}
    assert [bool(got[i].derived) for i in range(5)] == [True, False, False, True, False]
    assert "source-digest-matches: false" in got[3].derived[1].record
    assert warc.derive(df.limit(0)).collect() == []


def test_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    responses = warc.responses(pages).coalesce(1)
    warc.write(responses, f"{tmp_path}/w")
    data = next(tmp_path.glob("w/part-*")).read_bytes()
    want, seen = {r.record for r in responses.collect()}, set()
    while data:
        fields, block = warc.parse(data)
        size = data.index(b"\r\n\r\n") + 4 + len(block)
        seen.add(data[:size].decode())
        assert data[size:size + 4] == b"\r\n\r\n"
        data = data[size + 4:]
    assert seen == want


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op9_warc_derivatives(spark, SF).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        if r.record_type == "conversion":
            assert r.block_digest == "sha1:" + hashlib.sha1(brute(pages[r.page_id].html).encode()).hexdigest()


def test_digests_in_either_base_and_of_other_algorithms():
    page = b"<p>\xc3\xa9"
    for name, plain in (("sha1", hashlib.sha1(page)), ("SHA1", hashlib.sha1(page)), ("md5", hashlib.md5(page)), ("sha256", hashlib.sha256(page)), ("sha-256", hashlib.sha256(page))):
        for value in (plain.hexdigest(), plain.hexdigest().upper(), base64.b32encode(plain.digest()).decode(), base64.b32encode(plain.digest()).decode().rstrip("=")):
            assert warc.same_digest(f"{name}:{value}", page) and not warc.same_digest(f"{name}:{value}", page + b"x")
    for odd in ("", "sha1", "sha1:", "crc32:00", "shake_128:00", hashlib.sha1(page).hexdigest()):
        assert not warc.same_digest(odd, page)
    source = warc.response("u", page, "1").replace(warc.digest(page).encode(), b"sha1:" + base64.b32encode(hashlib.sha1(page).digest()))
    assert "source-digest-matches: true" in warc.derivatives(source)[1]["record"]


def test_text_keys_with_line_ends(spark):
    rows = [("a\nb", "http://x/", "<p>1"), ("", "http://y/", "2\n\n3"), (None, None, None), ("é\r\n", "u\nv", "\n")]
    made = {r.k: warc.parse(r.record.encode()) for r in warc.responses(spark.createDataFrame(rows, "k string, url string, html string"), key="k").collect()}
    for k, url, page in rows:
        fields, block = made[k]
        assert fields["warc-target-uri"] == (url or "").replace("\n", " ") and block.split(b"\r\n\r\n", 1)[1].decode() == (page or "")
    assert len({f["warc-record-id"] for f, _ in made.values()}) == 4
