from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import divergence


def plainly(rows, least, added, whole, top):
    docs = [(lang or "", source or "", "".join(c.lower() if c.isascii() else c for c in text or "")) for text, lang, source in rows]
    split = [(lang, source, Counter("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text).split())) for lang, source, text in docs]
    seen, n, groups = Counter(), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, words in split:
        seen.update((lang, w) for w in words)
        n[lang, source].update(words)
        n[lang].update(words)
    out = []
    for lang, source in groups:
        kept = [w for (g, w), c in seen.items() if g == lang and c >= least]
        part = lambda key: {w: 1 + whole * (n[key][w] + added) // (sum(n[key][x] for x in kept) + added * len(kept)) for w in kept}
        p, q = part((lang, source)), part(lang)
        pairs = [(b, sum(abs(p[w] - v) for w, v in part((lang, b)).items())) for a, b in groups if a == lang and b != source]
        terms = [(w, p[w] - q[w]) for w in kept if n[lang, source][w] and p[w] > q[w]]
        for name, listed, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, name, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_equal_to_plain_counting(frame):
    words = ["Aa", "bb", "c-c", "Éé", "日本", "x1y"]
    rows = [(" ".join(words[(i * k) % 6] for k in range(1, 1 + i % 9)), ("en", "fr", None)[i % 3], f"s{i % 4}") for i in range(60)]
    rows += [(None, "en", "silent"), ("", None, None), ("12 34", "de", "a"), ("rare", "de", "b"), ("twice", "en", "s1"), ("twice", "en", "s1")]
    docs = frame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("n"))
    found = divergence.divergence(docs, least_docs=3, top=2)
    assert sorted(map(tuple, found.collect())) == plainly(rows, 3, 5, 10**9, 2)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_awkward_rows(awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") == 5, "long"))
    rows = divergence.divergence(docs, least_docs=1).collect()
    assert {(r["part"], r["item"]) for r in rows if r["source"] == "long"} == {("pair", ""), ("term", "word")}
