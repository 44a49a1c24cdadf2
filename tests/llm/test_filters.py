import re
from collections import Counter

import duckdb
import pytest

from stratafolio.llm import quality_rules, url_reputation
from stratafolio.llm.oracles import ORACLES
from stratafolio.llm.queries import QUERIES

SPACE = r"[^\x20\x09-\x0D]+"


def measures(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_python(spark):
    texts = [None, "", " \n\t", "one", "a b a b a b a b", "x\ny\nx\n\n x", "é ü #$% | <b>", "w " * 400, "the cat sat on the mat and the dog ran " * 9, "a b c d a b c", "same line\n" * 30, " ".join(f"u{k}" for k in range(3000))]
    texts += [" ".join(f"w{k % n}" for k in range(200)) for n in (60, 90)]
    docs = spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(texts)] + [(None, "text", 1, True)], "doc_id long, text string, m int, kept boolean")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.row.doc_id is not None:
            m = r.m
            n = measures(texts[r.row.doc_id])
            assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.kept and (r.base_failed or r.broken))
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_verdicts_follow_the_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_quality_rules"](spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in got) / len(got) > 0.95


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/en/12", "https://a.example.org/es/x?y://z", "x://com/fr/", "http://b.com/de/1#f", "http://org", "http://org/", "http://notorg/", "http://éxample.com/q", "http://h.com?x", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "host string, good int")
    for r in url_reputation.judged(pages, none).collect():
        host, path = parts(urls[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict or "allow")
    assert url_reputation.judged(pages.limit(0), none).collect() == []


def test_bad_hosts_are_blocked_and_rare_ones_shrunk(spark):
    outcomes = [("bad.x.net", 0)] * 60 + [("good.y.net", 1)] * 60 + [(f"h{k}.z.net", k % 5 > 0) for k in range(40)] + [("rare.y.net", 0), (None, 0), ("good.y.net", None)]
    frame = spark.createDataFrame([(h, None if g is None else int(g)) for h, g in outcomes], "host string, good int")
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(["bad.x.net", "good.y.net", "rare.y.net", "new.y.net", "new.q.net"])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_reputation.judged(pages, frame).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = con.execute(ORACLES[name])
    columns = [d[0] for d in out.description]
    want = sorted(map(repr, out.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, sf).collect()) == want
