"""The fitted models and the pair permutations again, in plain Python."""

import datetime
import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafolio.llm import language_id, pii
from stratafolio.llm import quality_classifier as qc
from stratafolio.llm.queries import op2_language_id, op8_quality_classifier

from .test_pii import KEY, plain_text

# --- quality classifier


def plain_features(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw.lower())
    n = max(len(words), 1)
    chars = max(sum(b >= 33 for b in raw), 1)
    lines = [x for x in raw.lower().split(b"\n") if re.search(rb"[^ \t\n\x0b\x0c\r]", x)]
    triples = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    out = [
        math.log(1 + len(words)), sum(len(w) for w in words) / n, sum(raw.count(bytes([b])) for b in b"#*$%&|<>=~^{}[]\\_@") / n, sum(65 <= b <= 90 for b in raw) / chars,
        raw.count(b"!") / n, sum(48 <= b <= 57 for b in raw) / chars, sum(w in qc.STOP for w in words) / n, len(set(words)) / n, sum(c for c in triples.values() if c > 1) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log(1 + len(words) / max(len(lines), 1)), sum(b >= 128 for b in raw) / chars,
    ]
    return [float(np.float32(v)) for v in out]


def plain_edges(values, bins):
    s, out = sorted(values), []
    for k in range(1, bins):
        at = k / bins * (len(s) - 1)
        low = int(at)
        out.append(s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low))
    return sorted(set(out))


def value(g, h):
    return -g / (h + qc.SMOOTH)


def won(parts, whole):
    score = lambda p: p[0] ** 2 / (p[1] + qc.SMOOTH)
    return sum(map(score, parts)) - score(whole)


def plain_tree(g, h):
    leaves = [(0, len(g))]
    total = lambda a, b: (sum(g[a:b]), sum(h[a:b]))
    for _ in range(2):
        cuts = [(won([total(a, k), total(k, b)], total(a, b)), (a, b), k) for a, b in leaves for k in range(a + 1, b)]
        best = max(cuts, key=lambda c: c[0], default=(0, None, None))
        if best[0] <= 1e-9:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    return [next(value(*total(a, b)) for a, b in leaves if a <= k < b) for k in range(len(g))]


def plain_quadrants(g, h):
    rows, cols = len(g), len(g[0])
    total = lambda i, j, m, n: (sum(g[r][c] for r in range(i, m) for c in range(j, n)), sum(h[r][c] for r in range(i, m) for c in range(j, n)))
    best = (0.0, None)
    for i in range(1, rows):
        for j in range(1, cols):
            parts = [total(0, 0, i, j), total(0, j, i, cols), total(i, 0, rows, j), total(i, j, rows, cols)]
            w = won(parts, total(0, 0, rows, cols))
            if w > best[0]:
                best = (w, [[value(*parts[2 * (r >= i) + (c >= j)]) for c in range(cols)] for r in range(rows)])
    return best[0], best[1] or [[0.0] * cols for _ in range(rows)]


def plain_fit(x, y):
    k = range(len(x[0]))
    share = (sum(y) + 1) / (len(y) + 2)
    total = [math.log(share / (1 - share))] * len(y)
    base = total[0]
    edges, coarse = [plain_edges([r[f] for r in x], qc.BINS) for f in k], [plain_edges([r[f] for r in x], qc.COARSE) for f in k]
    bins, wide = [[bisect_right(edges[f], r[f]) for r in x] for f in k], [[bisect_right(coarse[f], r[f]) for r in x] for f in k]
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def gradients():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

    def sums(where, v, n):
        out = [0.0] * n
        for at, w in zip(where, v):
            out[at] += w
        return out

    def grid(a, b, v):
        out = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
        for i, j, w in zip(wide[a], wide[b], v):
            out[i][j] += w
        return out

    for _ in range(qc.ROUNDS):
        for f in k:
            g, h = gradients()
            for at, v in enumerate(plain_tree(sums(bins[f], g, len(tables[f])), sums(bins[f], h, len(tables[f])))):
                tables[f][at] += qc.RATE * v
                step = qc.RATE * v
                for r, b in enumerate(bins[f]):
                    if b == at:
                        total[r] += step
    g, h = gradients()
    first = {p: plain_quadrants(grid(*p, g), grid(*p, h))[0] for p in combinations(k, 2)}
    pairs = {p: grid(*p, [0.0] * len(y)) for p in sorted(first, key=first.get, reverse=True)[: qc.PAIRS] if first[p] > 0}
    for _ in range(qc.PAIR_ROUNDS):
        for a, b in pairs:
            g, h = gradients()
            step = plain_quadrants(grid(a, b, g), grid(a, b, h))[1]
            for r in range(len(y)):
                total[r] += qc.RATE * step[wide[a][r]][wide[b][r]]
            pairs[a, b] = [[u + qc.RATE * v for u, v in zip(s, t)] for s, t in zip(pairs[a, b], step)]

    def score(row):
        t = base + sum(tables[f][bisect_right(edges[f], row[f])] for f in k)
        return 1 / (1 + math.exp(-(t + sum(v[bisect_right(coarse[a], row[a])][bisect_right(coarse[b], row[b])] for (a, b), v in pairs.items()))))

    return score


def test_quality_scores_against_plain_python(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs)
    score = plain_fit([plain_features(docs[k]) for k, _ in labels], [q for _, q in labels])
    got = {r.doc_id: r.score for r in op8_quality_classifier(spark, sf).collect()}
    assert len(labels) > 40 and got == {k: pytest.approx(score(plain_features(t)), abs=1e-6) for k, t in docs.items()}


# --- language identification


def plain_grams(text):
    out, points = Counter(), [ord(c) for c in text.lower()]
    a, b, c = 2654435761, 2246822519, 3266489917
    mask = 0xFFFFFFFF
    for k in range(len(points)):
        h = points[k] * a & mask
        out[((h ^ h >> 13) * b & mask) >> 17] += 1
        for n, spread in ((1, b), (2, c)):
            if k + n < len(points):
                h = ((h ^ h >> 15) * spread + points[k + n] * a) & mask
                out[((h ^ h >> 13) * b & mask) >> 17] += 1
    return out


def plain_language(training, sample):
    usable = [t for t, lang in training if t is not None and lang is not None and any(map(str.isalpha, t))]
    df = Counter(g for t in usable for g in plain_grams(t))
    idf = lambda g: math.log((1 + len(usable)) / (1 + df[g])) + 1
    labels = sorted({lang for _, lang in sample})

    def vector(text):
        x = {g: (1 + math.log(n)) * idf(g) for g, n in plain_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()}

    def softmax(s):
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    seen = [(vector(t), labels.index(lang)) for t, lang in sample]
    train, rest = [s for k, s in enumerate(seen) if k % 4], seen[::4]
    z, n = {}, {}

    def weights(g):
        zs, ns = z.get(g, [0.0] * len(labels)), n.get(g, [0.0] * len(labels))
        return [0.0 if abs(a) <= language_id.L1 else (math.copysign(language_id.L1, a) - a) / ((language_id.BETA + math.sqrt(b)) / language_id.ALPHA + language_id.L2) for a, b in zip(zs, ns)]

    rng = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for k in rng.permutation(len(train)):
            x, y = train[k]
            w = {g: weights(g) for g in x}
            p = softmax([sum(v * w[g][c] for g, v in x.items()) for c in range(len(labels))])
            p[y] -= 1
            for g, v in x.items():
                zs, ns = z.setdefault(g, [0.0] * len(labels)), n.setdefault(g, [0.0] * len(labels))
                for c in range(len(labels)):
                    slope = v * p[c]
                    zs[c] += slope - (math.sqrt(ns[c] + slope * slope) - math.sqrt(ns[c])) / language_id.ALPHA * w[g][c]
                    ns[c] += slope * slope
    final = {g: weights(g) for g in z}
    scores = lambda x: [sum(v * final[g][c] for g, v in x.items() if g in final) for c in range(len(labels))]
    held = [(scores(x), y) for x, y in rest]
    loss = lambda t: -sum(math.log(softmax([v / t for v in s])[y]) for s, y in held)
    temperature = min(np.geomspace(0.2, 20, 121), key=loss)

    def predict(text):
        if text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax([v / temperature for v in scores(vector(text))])
        best = p.index(max(p))
        return labels[best], p[best]

    return predict


def test_languages_against_plain_python(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: (r.text, r.lang) for r in frame.collect()}
    seen = {k: v for k, v in docs.items() if zlib.crc32(str(k).encode()) % 5}
    training = frame.where(F.col("doc_id").isin(list(seen)))
    sample = language_id.sample_of(training.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")), F.col("lang"), language_id.SAMPLE)
    assert Counter(sample) == Counter((t, lang) for t, lang in seen.values() if re.search(r"[^\W\d_]", t or ""))  # all of them
    predict = plain_language(list(seen.values()), sample)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language_id(spark, sf).collect()}
    for k, (t, _) in docs.items():
        label, score = predict(t)
        assert got[k] == (label, pytest.approx(score, abs=2e-3)), k


# --- pseudonyms made of pairs of numbers


def plain_pair(x, y, a, b, kind):
    def number(turn, other):
        return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{other}".encode()).hexdigest()[:15], 16)

    first = (x, y)
    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            x = (x + number(turn, y)) % a
        else:
            y = (y + number(turn, x)) % b
    return (x, y) if (x, y) != first else (x, (y + 1) % b)


def plain_ip(v):
    o = list(map(int, v.split(".")))
    x, y = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def plain_ip6(v):
    head, _, tail = v.partition("::")
    groups = lambda s: [g for g in s.split(":") if g]
    zeros = 8 - len(groups(head)) - len(groups(tail)) if "::" in v else 0
    digits = "".join(g.rjust(4, "0") for g in groups(head) + ["0"] * zeros + groups(tail)).lower()
    out = plain_text(digits, "ip6", (pii.HEX_LOWER,))
    return ":".join(out[k : k + 4] for k in range(0, 32, 4))


def plain_iban(v):
    bare = v.replace(" ", "")
    new = plain_text(bare[4:], "iban")
    number = int("".join(str(int(c, 36)) for c in new + bare[:2] + "00"))
    whole = f"{bare[:2]}{98 - number % 97:02d}{new}"
    return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if " " in v else whole


def plain_ssn(v):
    area, group, serial = map(int, v.split("-"))
    x, y = plain_pair((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    return f"{x // 99 + (2 if x >= 665 * 99 else 1):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def plain_date(v):
    forms = ["%Y-%m-%d"] if v[4] in "-/" else ["%d-%m-%Y", "%m-%d-%Y"]
    plain = re.sub(r"\D", "-", v)
    for form in forms:
        try:
            day = datetime.datetime.strptime(plain, form)
            break
        except ValueError:
            continue
    start = datetime.datetime(1700, 1, 1)
    n = (day - start).days
    x, y = plain_pair(n // 773, n % 773, 189, 773, "date")
    return (start + datetime.timedelta(days=x * 773 + y)).strftime(form).replace("-", re.search(r"\D", v)[0])


VALUES = {
    plain_ip: ["10.0.0.1", "255.255.255.255", "0.0.0.0", "192.168.17.44"],
    plain_ip6: ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "fe80:1234:5678:9abc:def0:1234:5678:9abc", "2001:db8:1::"],
    plain_iban: ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"],
    plain_ssn: ["123-45-6789", "667-01-0001", "001-01-0001", "899-99-9999", "665-99-9999"],
    plain_date: ["1999-02-28", "31/12/2024", "12/31/1999", "2000/02/29", "01.02.1703", "2099-12-31"],
}


@pytest.mark.parametrize("plain", VALUES, ids=lambda f: f.__name__)
def test_pseudonyms_against_plain_python(spark, plain):
    rows = spark.createDataFrame([(k, f"see {v} there") for k, v in enumerate(VALUES[plain])], "doc_id long, text string")
    got = {r.k: r.text for r in pii.pseudonymised(rows, KEY).select(F.col("row.doc_id").alias("k"), "text").collect()}
    assert got == {k: f"see {plain(v)} there" for k, v in enumerate(VALUES[plain])}
