import math
import random
import statistics

from pyspark.sql import functions as F

from strataloom.llm import quality_lm as q

from .helpers import documents, rows


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["an", "th", "er", "on", "re"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def log_p(table, unknown, order, context, char):
    s, total = context + char, unknown
    for n in range(1, order + 1):
        total += table.get(s[len(s) - n :], (0.0, None))[0]
    for n in range(1, order):
        total += table.get(context[len(context) - n :], (0.0, None))[1] or 0.0
    return total


def test_model_is_a_distribution_and_matches_a_plain_implementation(spark):
    rnd = random.Random(1)
    texts = [prose(rnd, 30) for _ in range(20)] + [None, "", "Ünï zz"]
    features, unknown = q.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=4)
    table = {r.g: (r.gain, r.backoff) for r in features.collect()}
    chars = [g for g in table if len(g) == 1]
    for context in ("\x02\x02 ", "\x02 a", " th", "qqq", "Ün "):
        total = sum(math.exp(log_p(table, unknown, 4, context, c)) for c in chars) + math.exp(log_p(table, unknown, 4, context, "☃"))
        assert abs(total - 1) < 1e-9
    counts = {}
    for t in texts:
        s = f"\x02\x02 {' '.join((t or '').split())} " if t else ""
        for i in range(len(s) - 3):
            counts[s[i : i + 4]] = counts.get(s[i : i + 4], 0) + 1
    got = {r.g: r.c for r in q.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), 4).collect()}
    assert got == counts
    # The highest order by the textbook formula.
    n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]
    for g in list(counts)[:50]:
        own = {k: c for k, c in counts.items() if k[:3] == g[:3]}
        total = sum(own.values())
        gamma = sum(d[min(c, 3) - 1] for c in own.values()) / total
        below = math.exp(log_p(table, unknown, 3, g[1:3], g[3]))
        want = (counts[g] - d[min(counts[g], 3) - 1]) / total + gamma * below
        assert abs(math.exp(log_p(table, unknown, 4, g[:3], g[3])) - want) < 1e-9


def test_head_and_tail_give_the_same_scores(spark):
    rnd = random.Random(2)
    docs = documents(spark, [(i, prose(rnd, 25)) for i in range(30)] + [(50, None), (51, ""), (52, "§§§ ünknown"), (53, "an " * 20000), (None, "th"), (7, "twice"), (7, "twice")])
    features, unknown = q.fit(docs.filter("doc_id < 20").select("text"), order=4)
    a = sorted(rows(q.score(docs, features, unknown, order=4).select("doc_id", "n_chars", F.round("logp", 6))), key=str)
    table = {r.g: (r.gain, r.backoff) for r in features.collect()}
    for d, text in rows(docs.select("doc_id", "text")):  # the plain formula, character by character
        s = f"\x02\x02 {' '.join((text or '').split())} " if text else ""
        want = sum(log_p(table, unknown, 4, s[i - 3 : i], s[i]) for i in range(3, len(s)))
        assert (d, max(0, len(s) - 3)) in {(x, n) for x, n, p in a if abs(p - want) < 1e-4}
    for head in (0, 15):
        b = sorted(rows(q.score(docs, features, unknown, order=4, head=head).select("doc_id", "n_chars", F.round("logp", 6))), key=str)
        assert a == b
    assert len(a) == 37


def test_classifier_separates_prose_from_junk(spark):
    rnd = random.Random(3)
    good = [(i, prose(rnd, 60), "en" if i % 2 else "de") for i in range(200)]
    junk = [(1000 + i, "".join(chr(rnd.randrange(33, 126)) for _ in range(300)), "en") for i in range(20)]
    docs = documents(spark, good + junk + [(2000, None), (2001, "", None), (2002, prose(rnd, 60), "xx")])
    out = {r.doc_id: r for r in q.classify(docs, documents(spark, good[:100]).select("doc_id")).collect()}
    assert sum(out[d].kept for d, *_ in good) > 180 and not any(out[d].kept for d, *_ in junk)
    assert not out[2000].kept and out[2001].perplexity is None and out[2002].kept
    assert q.classify(documents(spark, []), documents(spark, []).select("doc_id")).collect() == []
    assert all(not r.kept or r.threshold is None or r.perplexity is not None for r in q.classify(docs, documents(spark, []).select("doc_id")).collect())


def test_limits_and_verdicts_against_plain_code(spark):
    """A language with enough trusted documents, one with few, one with none, null lang, ties, short texts, repeated rows."""
    rnd = random.Random(4)
    made = lambda i: prose(rnd, rnd.randrange(1, 40)) + " zq" * rnd.choice([0, 0, 0, 1, 6])
    texts = [(i, made(i), "en" if i < 40 else "de" if i < 46 else None if i < 50 else "xx") for i in range(60)]
    texts += [(60, texts[0][1], "en"), (61, texts[0][1], "en"), (62, None, "en"), (63, "", None), (64, "th", "de"), (5, texts[5][1], "en"), (None, "an zq zq", "de")]
    docs = documents(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in [*range(48), 60, 62, 62, 900, None]], "doc_id long")
    order, prior, quantile, least = 3, 20.0, 0.8, 10
    out = q.classify(docs, trusted, order=order, prior=prior, quantile=quantile, least=least).collect()
    ids = {*range(48), 60, 62}
    fold = {r.i: r.f for r in spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(65)], F.lit(None).cast("long"))).alias("i")).select("i", F.pmod(F.xxhash64("i"), F.lit(2)).alias("f")).collect()}
    tables = []
    for k in range(2):
        features, unknown = q.fit(spark.createDataFrame([(t,) for i, t, _ in texts if i in ids and fold[i] != k], "text string"), order)
        tables.append(({r.g: (r.gain, r.backoff) for r in features.collect()}, unknown))
    scored = []
    for i, text, lang in texts:
        s = f"\x02 {' '.join((text or '').split())} " if text else ""
        table, unknown = tables[fold[i]]
        scored.append((i, lang or "", max(0, len(s) - 2), sum(log_p(table, unknown, order, s[j - 2 : j], s[j]) for j in range(2, len(s)))))
    judges = [(lang, n, p) for i, lang, n, p in scored if i in ids and n]
    mean = lambda rows: -sum(p for _, _, p in rows) / sum(n for _, n, _ in rows)
    means = {x: mean([j for j in judges if j[0] == x]) for x in {j[0] for j in judges}}
    drawn = lambda lang, n, p: (-p + prior * means.get(lang, mean(judges))) / (n + prior)
    at = lambda values: sorted(values)[math.ceil(quantile * len(values)) - 1]
    over = [drawn(*j) - means[j[0]] for j in judges]
    above = max(at(over), statistics.stdev(over) * statistics.NormalDist().inv_cdf(quantile))
    limits = {}
    for x, m in means.items():
        own = [drawn(*j) for j in judges if j[0] == x]
        limits[x] = at(own) if len(own) >= least else max(at(own), m + above)
    assert sum(j[0] == "en" for j in judges) >= least > sum(j[0] == "de" for j in judges)
    limits["xx"] = at([drawn(*j) for j in judges])
    want = sorted((i if i is not None else -1, lang, n, n > 0 and drawn(lang, n, p) <= limits[lang] + 1e-9) for i, lang, n, p in scored)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.lang, r.n_chars, r.kept) for r in out) == want
    assert {k for *_, k in want} == {True, False} and not all(k for _, x, n, k in want if x == "en" and n)
    assert all(abs(math.log(r.threshold) - limits[r.lang]) < 1e-6 for r in out)
    near = {(i, n): p for i, _, n, p in scored}
    assert all(abs(r.n_chars * math.log(r.perplexity) + near[r.doc_id, r.n_chars]) < 1e-4 for r in out if r.n_chars)
