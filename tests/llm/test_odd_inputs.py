"""Strings that agree under weak hashes, repeated and missing ids, awkward column names, long texts."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, brute_components, brute_counts, brute_repeats, listed

from quorix.llm import chunks, common, decontaminate, jaccard, katz, mixing, rules, suffixes, tokens, warc


def say_words(seed, n, letters=3):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(letters, letters + 3))) for _ in range(n))


def thue_morse(n, a, b):
    """The word of n letters and its mirror: equal under any polynomial modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_mirrored_words_stay_apart(spark, n):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [w for pair in ("ab", "eq", "xz") for w in thue_morse(n, *pair)]
    rows = [(i, t, "en", "a", n) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    assert tokens.Counter(open(path, "rb").read()).counts(pa.array(texts)).tolist() == [len(library.encode(t).ids) for t in texts]
    assert listed(jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")) == brute_components(rows)
    assert listed(suffixes.repeat_report(docs)) == brute_repeats(rows)
    known = {r.doc_id: r.n_known for r in katz.score(docs, katz.fit(docs.where("doc_id % 2 = 0"))).collect()}
    assert known == {i: 1 + (i % 2 == 0) for i in range(6)}
    parts = chunks.Chunks(pa.table({"doc_id": list(range(6)), "text": texts}), "doc_id", "text")
    names = [parts.data[a:b].tobytes() for a, b in zip(parts.first, parts.last, strict=True)]
    assert [names[i] for i in parts.at[parts.back]] == names


def test_strings_are_hashed_by_all_their_bytes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 63, 511, 512, 513, 700) for _ in range(30)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    got = common.string_hashes(data, start, end)
    assert len(set(got.tolist())) == len(set(strings))
    assert all((got[i] == got[j]) == (strings[i] == strings[j]) for i in range(0, len(strings), 7) for j in range(len(strings)))
    a, b = np.array([rng.randrange(len(strings)) for _ in range(500)]), np.array([rng.randrange(len(strings)) for _ in range(500)])
    size = np.minimum((end - start)[a], (end - start)[b])
    same = common.same_strings(data, start[a], start[b], size)
    assert same.tolist() == [strings[i][:n] == strings[j][:n] for i, j, n in zip(a, b, size, strict=True)]


def test_a_unique_text_of_a_repeated_id_stays(spark):
    x, y = say_words(1, 60), say_words(2, 60)
    for rows in ([(2, x), (5, x + " more"), (5, y)], [(5, y), (2, x), (5, x + " more")], [(5, x + " more"), (5, y), (2, x)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, jaccard.keep_one(docs).collect())) == [(2, x), (5, y)]
    rows = [(7, x), (7, x), (7, x + " more"), (None, x), (None, y), (None, y + " more"), (9, ""), (9, ""), (9, " ")]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(k[0] == 7 for k in kept) == 1 and sum(k[0] is None for k in kept) == 1 and sorted(k for k in kept if k[0] == 9) == [(9, ""), (9, " ")]


def test_columns_of_any_name_pass(spark):
    rows = [(i, say_words(i % 7, 80), "en", "a", 5, i, "x", i) for i in range(30)]
    docs = spark.createDataFrame(rows, f"{DOCS}, `meta.url` long, `a``b` string, `_key` long")
    for out in (rules.keep_good(docs), jaccard.keep_one(docs), suffixes.remove_repeats(docs, "gone").drop("gone"), mixing.mixed_documents(docs).drop("copies"), decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, say_words(99, 20))], "item_id long, text string"))):
        assert out.columns == docs.columns
        assert {r["meta.url"] for r in out.collect()} <= set(range(30))


def test_documents_without_an_id_are_mixed_to_the_target(spark):
    rows = [(None, say_words(i, 100), "en", s, 0) for s in ("a", "b") for i in range(200)] + [(4, say_words(1000 + i, 100), "en", "c", 0) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 100 for r in got)


def test_short_items_condemn_nothing(spark):
    docs = spark.createDataFrame([(i, "the " + say_words(i, 40)) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, " ".join(say_words(3, 40).split()[:10]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench, shortest=decontaminate.SHORTEST).collect()} == set(range(20)) - {3}
    assert decontaminate.remove_contaminated(docs, bench).count() == 0


def brute_overlaps(text, item):
    """Whether, at some shift, a run that agrees in 0.7 of its tokens agrees in enough of them."""
    t, w = text.lower().split(), item.lower().split()
    least = min(13, math.ceil(0.7 * len(w) - 1e-9))
    for shift in range(-len(w), len(t)):
        same = [t[i + shift] == w[i] if 0 <= i + shift < len(t) else None for i in range(len(w))]
        same = [x for x in same if x is not None]
        for a in range(len(same)):
            agreed = 0
            for b in range(a, len(same)):
                agreed += same[b]
                if agreed >= least and 10 * agreed >= 7 * (b - a + 1):
                    return True
    return False


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    items = [say_words(500 + i, rng.randint(8, 40)) for i in range(12)]
    texts = []
    for k in range(60):
        own = rng.choice(items).split()
        own = [w if rng.random() > 0.35 * rng.random() else "other" for w in own][: rng.randint(5, 40)]
        texts.append(" ".join([*say_words(k, rng.randint(0, 20)).split(), *own, *say_words(k + 60, rng.randint(0, 20)).split()]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute_overlaps(t, x)}


def test_fences_follow_the_groups(spark):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        for i in range(120):
            # Repeats, marks and word lengths differ from group to group.
            text = say_words(g * 1000 + i, 70, 2 + g) + (" " + " ".join(["so it goes on"] * rng.randint(0, 2 + 2 * g)) if rng.random() < 0.2 else "") + " &" * rng.randint(0, g)
            rows.append((g * 1000 + i, text, "en", f"s{g}", 0))
    found = rules.learned_fences(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 6
    for k in range(3):
        assert len({r.upper[k] for r in found}) >= 4
    assert len({r.lower[1] for r in found}) >= 4


def test_counts_of_a_very_long_text(spark):
    text = say_words(3, 300_000) + "\n" + "one line\n" * 50
    assert len(text) > 1 << 20
    got = rules.judge(spark.createDataFrame([(1, text, "en", "a", 0), (2, "a b c a b c", "en", "a", 0)], DOCS)).where("doc_id = 1").first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_lines, got.n_dup_lines, got.n_repeat_words) == brute_counts(text)


def test_long_texts_cross_the_pieces(spark):
    long = say_words(5, 120_000)
    assert len(long) > 600_000
    rows = [(1, long, "en", "a", 0), (2, long[:400_000] + " tail", "en", "a", 0), (3, long[590_000:], "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r.n_removed for r in suffixes.repeat_report(docs).collect()}
    assert found == {1: 0, 2: 400_000, 3: len(long) - 590_000}
    gone = {r.doc_id: r.n_removed for r in chunks.dedup(docs).collect()}
    assert gone[1] == 0 and gone[2] >= 399_000 and gone[3] >= len(rows[2][1]) - 1100
    item = " ".join(long.split()[90_000:90_030])
    assert {r.doc_id for r in decontaminate.overlaps(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1} | {i for i, t, *_ in rows if item in t}
    near = spark.createDataFrame([(1, long), (2, "changed " + long), (3, say_words(6, 2000))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(near).collect()} == {1: 1, 2: 1, 3: 3}


def test_archives_ignore_other_columns(spark):
    from quorix.session import new_folder

    pages = spark.createDataFrame([(1, "u", "<p>", 5, "d"), (2, "v", "<p>", 6, "e")], "page_id long, url string, html string, n long, digest string")
    path = new_folder(spark, "warc")
    warc.write_archives(pages, path)
    assert {(r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()} == {(1, "revisit"), (2, "response")}


def brute_katz(train, order, d):
    """P(w | h) of a model of any order, from counts in dictionaries; h has order - 1 tokens."""
    pad = ["<s>"] * (order - 1)
    c = [collections.Counter() for _ in range(order + 1)]
    of = collections.Counter()
    for t in train:
        w = [*pad, *t, None]
        for i in range(len(pad), len(w)):
            for k in range(1, order + 1):
                c[k][tuple(w[i - k + 1 : i + 1])] += 1
                of[tuple(w[i - k + 1 : i])] += 1
    n = sum(c[1].values())
    cut = lambda k, x: (d[k][x] if x <= 5 else 1) * x
    left = 1 - sum(cut(1, x) for x in c[1].values()) / n
    share, left = (n / (n + 1), 1 / (n + 1)) if left < 1e-12 else (1, left)
    after = collections.defaultdict(list)
    for k in range(2, order + 1):
        for g in c[k]:
            after[g[:-1]].append(g[-1])

    def p(h, w):
        k = len(h) + 1
        if k == 1:
            return share * cut(1, c[1][w,]) / n if (w,) in c[1] else left
        if h not in after:
            return p(h[1:], w)
        mass = sum(cut(k, c[k][*h, x]) for x in after[h]) / of[h]
        whole = 1 - mass < 1e-12
        scale, rest = (of[h] / (of[h] + 1), 1 / (of[h] + 1)) if whole else (1, 1 - mass)
        if (*h, w) in c[k]:
            return scale * cut(k, c[k][*h, w]) / of[h]
        return rest / (1 - sum(p(h[1:], x) for x in after[h])) * p(h[1:], w)

    return p, [w for (w,) in c[1]], list(after)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order(spark, order):
    rng = random.Random(order)
    texts = [[rng.choice("aabbbcdefghij") for _ in range(rng.randint(0, 30))] for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    scores, model = katz.score_corpus(docs, F.col("doc_id") % 3 != 1, order)
    train = [t for i, t in enumerate(texts) if i % 3 != 1]
    p, words, contexts = brute_katz(train, order, model.d)
    want = {}
    for i, t in enumerate(texts):
        w = [*["<s>"] * (order - 1), *t, None]
        want[i] = sum(math.log10(p(tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w)))
    got = {r.doc_id: r.score for r in scores.collect()}
    assert got == pytest.approx(want, abs=1e-8)
    assert {r.doc_id: r.score for r in katz.score(docs, model).collect()} == pytest.approx(want, abs=1e-8)
    assert {r.doc_id: r.score for r in katz.score(docs, katz.fit(docs.where("doc_id % 3 <> 1"), order)).collect()} == pytest.approx(want, abs=1e-8)
    for h in [()] + [h for h in contexts if len(h) == order - 1][:20]:
        if len(h) == order - 1:
            assert sum(p(h, w) for w in words) + p(h, "no such word") == pytest.approx(1, abs=1e-9)


def test_discounts_are_good_turing():
    seen = [1000, 400, 220, 140, 100, 75, 9999]
    got = katz.discounts(seen)
    for c in range(1, 6):
        star = (c + 1) * seen[c] / seen[c - 1]
        tail = 6 * seen[5] / seen[0]
        assert got[c] == pytest.approx((star / c - tail) / (1 - tail))
    for odd in ([3, 0, 0, 0, 0, 0, 3], [1, 2, 3, 4, 5, 6, 21], [0, 0, 4, 0, 0, 0, 4], [10, 0, 3, 1, 1, 1, 30]):
        d = katz.discounts(odd)[1:]
        assert ((0 < d) & (d < 1)).all() and (np.diff(d) > 0).all()
    # A power law n(c) = 1000 c^-2 smooths to itself: c* = c (1 + 1/c)^-1.
    law = [1000 / c**2 for c in range(1, 7)]
    tail = 1 / 6
    assert katz.discounts([*law[:5], 0, 0])[1:] == pytest.approx([((c / (c + 1)) - tail) / (1 - tail) for c in range(1, 6)])
