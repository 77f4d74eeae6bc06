import brute
import duckdb
import odd_rows
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hackney.llm import line_rules, link_trust
from hackney.llm.oracle import ORACLE

OP5 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def in_duckdb(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df)
    return con.sql(sql).df()


def compared(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(map(str, got[cols].itertuples(index=False, name=None)))
    b = sorted(map(str, want[cols].itertuples(index=False, name=None)))
    assert a == b


def test_op5_base_rules_on_odd_rows(spark):
    got = odd_rows.sorted_rows(line_rules.op5(odd_rows.documents(spark)), *OP5)
    assert got == odd_rows.by_plain((d, *brute.base_rules(t)) for d, t in odd_rows.TEXTS)


def test_op5_equals_its_sql(spark):
    docs = spark.read.parquet(f"{odd_rows.SF}/documents.parquet")
    compared(line_rules.op5(docs).toPandas(), in_duckdb(ORACLE["op5_line_rules"], documents=docs.toPandas()))
    odd = odd_rows.documents(spark).filter("doc_id is not null").select("doc_id", "text")
    compared(line_rules.op5(odd).toPandas(), in_duckdb(ORACLE["op5_line_rules"], documents=odd.toPandas()))


def test_op5_of_an_empty_table(spark):
    assert line_rules.op5(odd_rows.documents(spark, [])).collect() == []


GOOD = "\n".join(" ".join(f"Word{k}x{j}" for j in range(12)) + "." for k in range(9))


@pytest.mark.parametrize(
    "bad",
    [
        "Home | About | Contact | Imprint | Help.",
        "Read more",
        "a line without any end to it at all",
        "$$$ *** buy now %%% &&& ###.",
        "Please read our Cookie Policy before you go on.",
    ],
)
def test_bad_lines_go_and_good_ones_stay(spark, bad):
    docs = spark.createDataFrame([(1, f"{bad}\n{GOOD}")], "doc_id long, text string")
    row = line_rules.clean_lines(docs).first()
    assert row["clean_text"] == GOOD and row["kept"]


def test_texts_that_lose_too_much_are_rejected(spark):
    menu = "\n".join(f"Entry{k} | Entry{k}a | Entry{k}b | Entry{k}c | Entry{k}d" for k in range(40))
    docs = spark.createDataFrame([(1, f"{menu}\n{GOOD}"), (2, GOOD)], "doc_id long, text string")
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in line_rules.op5(docs).collect()}
    assert kept == {1: (False, False), 2: (False, True)}


def test_counts_of_very_long_texts_do_not_overflow(spark):
    good = " ".join(f"w{k}x" for k in range(60)) + "."
    bad = F.expr("repeat('x', int(24000000 + id))")
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit(good), bad).alias("text"))
    row = line_rules.clean_lines(docs).first()
    assert not row["base_failed"] and not row["kept"] and row["clean_text"] == good


def test_counts_of_very_long_lines_do_not_overflow(spark):
    line = spark.range(1).select(F.concat(F.expr("repeat('word ', int(29000000 + id))"), F.lit("end.")).alias("x"))
    assert line.select(line_rules.line_fails(F.col("x"))).first()[0] is False


URLS = [
    "http://a.com/x",
    "HTTP://WWW.Example.COM/en/1?q=/es/",
    "https://spam.example.com/en/2",
    "https://b.net/es/",
    "https://b.net/de/es/",
    "https://net/fr/#x",
    "x://notcom/",
    "http://com?/",
    "http://.com/",
    None,
    "",
    "no scheme",
    "a://b://c.com/",
    "http://example.com/en",
    "http://É.COM/\n/en/",
]


def pages_of(spark, rows, more="page_id long, url string, html string, host string, verdict string"):
    return spark.createDataFrame([(*r, "h", "v") for r in rows], more)


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate(brute.LOWER)
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    path = path.split("?")[0].split("#")[0]
    fits = [
        r
        for r in link_trust.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_op2_rules_on_odd_urls(spark):
    pages = pages_of(spark, [(k, u, None) for k, u in enumerate(URLS)] + [(0, URLS[0], "")])
    rows = link_trust.op2(spark, pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = plain_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "allow")


def graph():
    """Hosts that link to blocked ones, hosts near trusted ones, and a hub."""
    a = lambda *hosts: "".join(f'<a class="x" HREF="https://{h}/p">t</a>' for h in hosts)
    rows = [(0, "http://bad.net/es/1", "")]
    rows += [(k, f"http://farm{k}.org/", a("bad.net")) for k in range(1, 4)]
    rows += [(10, "http://good.com/", a("friend.org", "hub.org"))]
    rows += [(11, "http://friend.org/", a("good.com", "friend.org"))]
    rows += [(12, "http://mixed.org/", a("good.com", "bad.net"))]
    rows += [(20 + k, f"http://leaf{k}.org/", a("hub.org")) for k in range(30)]
    rows += [(60, "http://hub.org/", a(*(f"leaf{k}.org" for k in range(30))))]
    return rows


def test_op2_spreads_distrust_to_those_who_link_to_blocked_hosts(spark):
    rows = link_trust.judge(spark, pages_of(spark, graph())).collect()
    by_host = {r["host"]: r for r in rows}
    assert {h for h, r in by_host.items() if r["verdict"] == "block"} >= {f"farm{k}.org" for k in range(1, 4)}
    assert by_host["friend.org"]["verdict"] == "allow" and by_host["friend.org"]["trust"] > 0
    assert all(by_host[f"leaf{k}.org"]["verdict"] == "allow" for k in range(30))


def test_op2_equals_plain_pagerank(spark):
    rows = graph()
    got = {r["host"]: (r["trust"], r["distrust"]) for r in link_trust.judge(spark, pages_of(spark, rows)).collect()}
    edges = set()
    for _, url, html in rows:
        src = url.split("/")[2]
        edges |= {(src, x.split("/")[2]) for x in html.split('"') if x.startswith("https://")}
    edges = {(s, d) for s, d in edges if s != d}

    def walk(edges, seeds):
        start = {h: link_trust.UNITS // len(seeds) for h in seeds}
        score = dict(start)
        for _ in range(link_trust.ROUNDS):
            new = {h: s * 15 // 100 for h, s in start.items()}
            for s, d in edges:
                if s in score:
                    n = sum(1 for x, _ in edges if x == s)
                    new[d] = new.get(d, 0) + score[s] * 85 // 100 // n
            score = new
        return score

    trust, doubt = walk(edges, {"good.com"}), walk({(d, s) for s, d in edges}, {"bad.net"})
    assert got == {h: (trust.get(h, 0), doubt.get(h, 0)) for h in got}


def test_op2_equals_its_sql(spark):
    odd = [(k, u, None) for k, u in enumerate(URLS)]
    for rows in (graph() + odd, []):
        pages = pages_of(spark, rows)
        frame = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"url": object, "html": object})
        if not rows:
            frame = frame.astype({"page_id": "int64", "url": "string", "html": "string"})
        compared(link_trust.op2(spark, pages).toPandas(), in_duckdb(ORACLE["op2_link_trust"], pages=frame))
    pages = spark.read.parquet(f"{odd_rows.SF}/pages.parquet")
    compared(link_trust.op2(spark, pages).toPandas(), in_duckdb(ORACLE["op2_link_trust"], pages=pages.toPandas()))


def chain(n):
    """``n`` hosts, each linking to the next, the last to a blocked one."""
    names = [f"h{k}.org" for k in range(n, 0, -1)] + ["bad.net"]
    link = '<a href="https://{}/">t</a>'
    rows = [(k, f"http://{a}/", link.format(b)) for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    return [*rows, (n, "http://bad.net/es/1", "")]


def test_op2_walks_until_scores_converge(spark):
    n = 15
    rows = link_trust.judge(spark, pages_of(spark, chain(n)), rounds=None).collect()
    got = {r["host"]: r["distrust"] / link_trust.UNITS for r in rows}
    for k in range(1, n + 1):
        assert got[f"h{k}.org"] == pytest.approx(0.15 * 0.85**k, rel=1e-6)


def test_op2_blocks_hosts_more_than_ten_links_from_a_blocked_one(spark):
    lone = [(100 + k, f"http://a{k}.org/", f'<a href="https://b{k}.org/">t</a>') for k in range(200)]
    rows = link_trust.op2(spark, pages_of(spark, chain(15) + lone)).collect()
    verdicts = {r["host"]: r["verdict"] for r in rows}
    assert all(verdicts[f"h{k}.org"] == "block" for k in range(1, 16))
    assert all(verdicts[f"a{k}.org"] == "allow" for k in range(200))


def test_op2_converges_on_a_cycle(spark):
    link = '<a href="https://{}/">t</a>'
    rows = [(0, "http://bad.net/es/1", link.format("x.org")), (1, "http://x.org/", link.format("bad.net"))]
    got = {r["host"]: r["distrust"] for r in link_trust.judge(spark, pages_of(spark, rows), rounds=None).collect()}
    for host, want in (("bad.net", 0.15 / (1 - 0.85**2)), ("x.org", 0.15 * 0.85 / (1 - 0.85**2))):
        assert abs(got[host] / link_trust.UNITS - want) < 0.5 * 6 / link_trust.PARTS


def test_hosts_keep_every_character(spark):
    urls = ["http://a\0b.example.com/en/x", "http://x\0example.com/en/", "HTTP://Ä.Example.COM?en", "a://b://c"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in rows.select(link_trust.host_of(F.col("url")), link_trust.path_of(F.col("url"))).collect()]
    assert got == [("a\0b.example.com", "/en/x"), ("x\0example.com", "/en/"), ("Ä.example.com", ""), ("b:", "//c")]


def test_rules_of_one_length_go_by_their_order(spark):
    rules = (link_trust.Rule("block", "a.com", "/b"), link_trust.Rule("allow", "com", "/bbb"))
    page = spark.range(1).select(F.lit("a.com").alias("host"), F.lit("/bbb").alias("path"))
    for some, first in ((rules, "block"), (rules[::-1], "allow")):
        what = link_trust.matched(some, F.col("host"), F.col("path"), lambda rule: rule.verdict)
        assert page.select(what).first()[0] == first
