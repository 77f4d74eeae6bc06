import gzip
import hashlib
import zlib

import odd_rows
import pytest

from hackney.llm import warc_derive as warc
from hackney.llm.scratch import shared_dir

PAGE = (
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style>'
    '<script>var t="</p>";</script></head><body><nav><a href="/x">X</a></nav><!-- hidden <p> -->'
    "<p>One  two&nbsp;<b>three</b><br>four &lt;five&gt;</p> 1 < 2</body></html>"
)
ROWS = [
    (1, "http://a.org/", PAGE),
    (1, "http://a.org/", PAGE),
    (2, None, None),
    (3, "http://b.org/\r\nX: y", ""),
    (None, "", "<p>unclosed <script>never ends"),
    (4, "http://c.org/", "plain é " * 50_000),
    (5, "http://d.org/", "<!-- never ends"),
]


def pages_of(spark, rows=ROWS):
    schema = "page_id long, url string, html string, path string, warc_type string"
    return spark.createDataFrame([(*r, "p", "w") for r in rows], schema)


def test_text_and_links_of_a_page():
    text, meta = warc.parse_page(PAGE)
    assert text == "A & B\nX\nOne two three\nfour <five>\n1 < 2"
    assert meta == {"title": ["A & B"], "charset": ["utf-8"], "link": ["/x"]}


@pytest.mark.parametrize("html", ["", "<", "<a", "<a href=x", "<!--", "<script>", "</", "a<b", "<p>&#x;", "<" * 999])
def test_broken_markup_is_read(html):
    text, _ = warc.parse_page(html)
    assert isinstance(text, str)


def test_records_are_linked_and_read_back():
    response = warc.response_of(1, "http://a.org/", PAGE)
    meta, conversion = warc.derive(response)
    for r in (meta, conversion):
        assert r.headers["WARC-Refers-To"] == response.headers["WARC-Record-ID"]
        assert r.headers["WARC-Target-URI"] == "http://a.org/"
        assert r.headers["WARC-Payload-Digest"] == warc.digest(PAGE.encode())
    assert meta.headers["WARC-Concurrent-To"] == conversion.headers["WARC-Record-ID"]
    assert b"source-header: WARC-Record-ID: <urn:uuid:" in meta.block
    assert b"source-header: Content-Type: text/html" in meta.block
    data = warc.member_of(meta) + warc.member_of(conversion)
    assert [(r.headers, r.block) for r in warc.read_records(data)] == [
        (r.headers, r.block) for r in (meta, conversion)
    ]
    plain = gzip.decompress(data)  # any reader of gzip sees both records
    assert plain.count(b"WARC/1.1\r\n") == 2
    again, _ = warc.derive(warc.response_of(1, "http://a.org/", PAGE))
    assert again.headers["WARC-Record-ID"] == meta.headers["WARC-Record-ID"]


def test_a_changed_byte_is_noticed():
    _, conversion = warc.derive(warc.response_of(1, "u", "<p>text"))
    conversion.block = b"texT"
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(warc.member_of(conversion)))


def test_op9_gives_both_records_of_every_page(spark):
    rows = warc.op9(spark, pages_of(spark)).collect()
    want = []
    for page, url, html in ROWS:
        for r in warc.derive(warc.response_of(page, url, html)):
            h = r.headers
            uri = h.get("WARC-Target-URI")
            want.append((page, h["WARC-Type"], h["WARC-Record-ID"], uri and warc._line(uri), len(r.block)))
    got = [(r["page_id"], r["warc_type"], r["record_id"], r["target_uri"], r["n_bytes"]) for r in rows]
    assert odd_rows.by_plain(got) == odd_rows.by_plain(want)
    text = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert text["block_sha256"] == hashlib.sha256(warc.parse_page(PAGE)[0].encode()).hexdigest()


def test_op9_of_an_empty_table_and_the_index(spark):
    assert warc.op9(spark, pages_of(spark, [])).collect() == []
    index = warc.write_derivatives(pages_of(spark), shared_dir(spark))
    assert index.count() == 2 * len(ROWS)
    assert index.select("path", "offset").distinct().count() == 2 * len(ROWS)


def test_letters_that_grow_in_lower_case_shift_nothing():
    text, _ = warc.parse_page("İ" * 9 + "<p>a</P><SCRIPT>x y</script>b<!-- c -->d")
    assert text == "İ" * 9 + "\na\nbd"


def stored(kind, block, *more, version="1.0"):
    """A WARC record in bytes, made by hand; ids follow from the block."""
    name = f"<urn:uuid:{hashlib.md5(block).hexdigest()}>"
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"warc-record-id: {name}", *more, f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body


def chunked(body, size=7):
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


HTML = "Content-Type: text/html; charset=utf-8"
CRAWL = {
    "plain": (http(b"<title>T</title><p>a</p>b", HTML), "T\na\nb"),
    "chunked": (http(chunked(b"<p>one</p><p>two"), "transfer-encoding: chunked", HTML), "one\ntwo"),
    "gzip": (http(gzip.compress(b"<p>zip"), "Content-Encoding: gzip", HTML), "zip"),
    "both": (http(chunked(zlib.compress(b"x<br>y")), "Content-Encoding: deflate", "Transfer-Encoding: chunked"), "x\ny"),
    "latin": (http("<p>é".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1"), "é"),
    "own": (http("<meta charset=windows-1251>я".encode("cp1251"), "Content-Type: text/html"), "я"),
    "odd": (http("<p>é".encode(), "Content-Type: text/html; charset=none-such"), "é"),
    "image": (http(b"\x89PNG <p>no text", "Content-Type: image/png"), None),
    "folded": (http(b"<p>f", "X-Long: one\r\n two", HTML), "f"),
    "empty": (http(b"", HTML), ""),
}


def test_responses_of_warc_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ids, files = {}, {"a b": b"", "plain": b"", "none": b""}
    for n, (key, (block, _)) in enumerate(CRAWL.items()):
        more = (f"WARC-Target-URI: http://x.org/{key}", "WARC-Date: 2020-01-02T03:04:05Z", "WARC-Payload-Digest: sha1:OWN")
        name, raw = stored("response", block, *more, version=("1.0", "1.1")[n % 2])
        ids[name] = key
        _, request = stored("request", http(key.encode()), "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>")
        files["plain" if n % 2 else "a b"] += request + raw
    files["plain"] += stored("response", b"no http", "Content-Type: text/dns")[1]
    # One member for two records, the next in a member of its own.
    (tmp_path / "in/a b.warc.gz").write_bytes(gzip.compress(files["a b"]) + gzip.compress(stored("warcinfo", b"x")[1]))
    (tmp_path / "in/plain.warc").write_bytes(files["plain"])
    (tmp_path / "in/none.warc").write_bytes(b"")
    index = warc.derive_files(spark, str(tmp_path / "in"), shared_dir(spark))
    got = {(ids[r["refers_to"]], r["warc_type"]): r for r in index.collect()}
    want = {(k, "metadata") for k in CRAWL} | {(k, "conversion") for k, v in CRAWL.items() if v[1] is not None}
    assert got.keys() == want and index.count() == len(want)
    read = {(ids[r["refers_to"]], r["warc_type"]): r for r in warc.read_derivatives(index).collect()}
    for (key, kind), row in read.items():
        assert row["target_uri"] == f"http://x.org/{key}" and row["payload_digest"] == "sha1:OWN"
        if kind == "conversion":
            assert row["block_sha256"] == hashlib.sha256(CRAWL[key][1].encode()).hexdigest(), key
            assert got[key, "metadata"]["concurrent_to"] == row["record_id"]
    assert got["image", "metadata"]["concurrent_to"] is None
    at = got["folded", "metadata"]
    with open(at["path"].removeprefix("file://"), "rb") as f:
        f.seek(at["offset"])
        (record,) = warc.read_records(f.read(at["length"]))
    assert b"source-header: X-Long: one two\r\n" in record.block
    assert b"source-header: WARC-Date: 2020-01-02T03:04:05Z\r\n" in record.block


def test_files_written_here_are_read_and_broken_ones_are_named(spark, tmp_path):
    records = [warc.Record(r.headers | {"Content-Length": str(len(b))}, b) for r, b in (
        (r, http(r.payload, *(f"{k}: {v}" for k, v in r.http)))
        for r in (warc.response_of(k, f"http://a.org/{k}", f"<p>{k}") for k in range(300))
    )]
    data = b"".join(warc.member_of(r) for r in records)
    (tmp_path / "whole.warc.gz").write_bytes(data)
    index = warc.derive_files(spark, str(tmp_path / "whole.warc.gz"), shared_dir(spark))
    made = warc.write_derivatives(
        spark.createDataFrame([(k, f"http://a.org/{k}", f"<p>{k}") for k in range(300)], "page_id long, url string, html string"),
        shared_dir(spark),
    )
    names = ("warc_type", "record_id", "refers_to", "target_uri", "payload_digest")
    assert odd_rows.sorted_rows(index, *names) == odd_rows.sorted_rows(made, *names)
    (tmp_path / "cut.warc.gz").write_bytes(data[: len(data) - 30])
    with pytest.raises(Exception, match="cut.warc.gz"):
        warc.derive_files(spark, str(tmp_path / "cut.warc.gz"), shared_dir(spark))
