"""The methods by which operators get their results, on small cases of their own."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import jaccard, near_vectors, packing, rules, substrings, token_files, toxicity
from waymark.llm._common import hash_words, table
from waymark.llm.queries import QUERIES
from waymark.llm.tokens import ChunkEncoder


def sequences(plan):
    return sum(n for _, n in plan)


def test_completion_beats_best_fit():
    counts = dict(Counter([18, 16, 11, 10, 10, 8, 7, 5, 4, 4]))
    assert sequences(packing.best_fit(counts, 24)) == 5 and sequences(packing.bin_completion(counts, 24)) == 4


def test_completions_are_the_undominated_ones():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 14) for _ in range(8)]
        room = rng.randint(5, 22)
        left = packing.Remaining(Counter(sizes), None)
        got = {tuple(sorted(k for k, m in filling for _ in range(m))) for filling, _ in left.completions(room, room)}
        want = set()
        for n in range(len(sizes) + 1):
            for own in combinations(range(len(sizes)), n):
                items, slack = [sizes[i] for i in own], room - sum(sizes[i] for i in own)
                if slack < 0:
                    continue
                outside = [sizes[i] for i in range(len(sizes)) if i not in own]
                sums = [(len(c), sum(c)) for k in range(1, n + 1) for c in combinations(items, k)]
                swaps = any(0 <= x - t <= slack and (k > 1 or x > t) for x in outside for k, t in sums)
                if not swaps and not any(x <= slack for x in outside):
                    want.add(tuple(sorted(items)))
        assert want <= got  # whatever is not dominated is found
        for items in got - want:  # and what else is found has room for a further piece, which less waste tells first
            assert any(x <= room - sum(items) for x in (Counter(sizes) - Counter(items)))


def test_search_ends_with_an_incumbent_when_its_steps_are_spent():
    counts = {k: 3 for k in range(301, 420, 7)}
    plan = packing.bin_completion(counts, 1000, effort=50)
    used = Counter()
    for content, n in plan:
        for k, m in content:
            used[k] += m * n
    assert used == Counter(counts)


def test_control_strings_are_ordinary_text():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(P.path(name))
        library.encode_special_tokens = True
        texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y z"]
        assert [x.tolist() for x in ChunkEncoder(P.path(name)).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_awkward_texts():
    rng = random.Random(6)
    parts = ["word", "Wörd", "it's", "42", "x.y", "...", ";", "日本", "É", "\t", "\n", "  ", "\r\n", "\xa0", " ", "\x1c", "a,", "#b", "ﬁ", "é"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = ChunkEncoder(P.path(name))
        want = [x.ids for x in own.library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(texts)] == want


def test_runs_of_ids_begin_with_words_of_their_own():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 50_000, 500), np.full(200, 7), rng.integers(0, 3, 300), [2**40]]).astype(np.uint64)
    ends = np.array([0, 10, 10, 480, 620, 999, len(ids)])
    words, cuts = token_files.encode_runs(ids, ends)
    for a, b, x, y in zip([0, *ends], ends, [0, *cuts], cuts):
        assert (token_files.decode_words(words[x:y]) == ids[a:b]).all()


def test_word_hashes_tell_words_apart():
    texts = [None, "", "ab c a bc", " Ab\tc\n\nx ", "a" * 70_000, "a" * 69_999 + "b", "é é"]
    for lower in (False, True):
        h, first = hash_words(pa.array(texts), lower)
        words = [w.lower() if lower and w.isascii() else w for t in texts for w in (t or "").split()]
        assert np.diff(first).tolist() == [len((t or "").split()) for t in texts]
        assert all((a == b) == (x == y) for (a, x), (b, y) in combinations(zip(words, h.tolist()), 2))
        sliced, at = hash_words(pa.array(texts).slice(2, 2), lower)
        assert sliced.tolist() == h[first[2] : first[4]].tolist() and at[0] == 0


def test_signatures_are_subsets_of_partitions():
    rng = np.random.default_rng(8)
    none = np.empty(0, np.uint64)
    for size in (6, 60, 600, 6000):
        s = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        k = jaccard.allowed(len(s))
        assert len(jaccard.signatures(s, none)) <= 2 * (2 * k + 2)
        other = np.sort(np.concatenate([s[k // 2 :], np.setdiff1d(rng.integers(0, 2**63, k - k // 2, dtype=np.int64).astype(np.uint64), s)]))
        common = len(np.intersect1d(s, other))
        if 100 * common >= 80 * (len(s) + len(other) - common):
            assert set(jaccard.signatures(s, none)) & set(jaccard.signatures(other, none))
    sig, held = jaccard.enumerated(s, 10, 0)
    assert len(sig) == 30 and held.sum() == 2 * len(s)  # each shingle is in two of its partition's three subsets


def test_levels_at_most_double():
    for width in (2, 8, 50, 100):
        lengths = [*substrings.levels(width), width]
        assert all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))
    assert substrings.levels(50) == [13, 25]


def test_a_window_shared_by_one_other_block_survives_all_levels(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"u{rng.getrandbits(60)}" for _ in range(n)]
    a, b = fresh(60), fresh(60)
    mixed = a[:30] + b[30:]  # shares half windows with both, and no window of 50
    texts = [a, b, mixed, fresh(20) + a + fresh(5), fresh(3) + b[5:] + fresh(9)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert [r["n_removed"] for r in substrings.dedup(df).orderBy("doc_id").collect()] == [0, 0, 0, 60, 55]


def test_vectors_of_null_and_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(None, v, "a"), (5, v, "a"), (5, None, "a"), (6, [0.0] * 3, "a"), (None, None, "a"), (7, w, "b"), (7, w, "b"), (8, v, "b"), (9, v, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.links(df).collect()), key=repr)
    assert got == sorted([(None, 1, 5, False), (5, 1, 5, True), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True)], key=repr)


def test_lines_have_states_of_their_own(spark):
    sf = "/root/testdata/sf0.01"
    model = rules.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    content = ["And the shore of that with these were in the hand, and they went on to the north.", "He said that no one had come by the house since the rain began in spring.", "Some of the older men of the town still tell it as they heard it then.", "It was not a long way, but the road was bad and the night was cold."]
    junk = ["BUY!! NOW!! CLICK!! HERE!! FREE!! SALE!! TODAY!! ONLY!! BEST!! PRICE!! HURRY!!", "WIN!! CASH!! FAST!! CALL!! US!! ANY!! TIME!! DAY!! OR!! NIGHT!! DEAL!!"]
    lines = [content[0], content[1], *junk, content[2], content[3]]
    (states,) = model.mark([rules.line_features("\n".join(lines).encode())[0]])
    assert states.tolist() == [1, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([(1, "\n".join(lines), "x"), (2, "\n".join([f"{junk[0]} LOT!! {'ABCDEFGH'[i]}{'KLMNOPQR'[i]}!!" for i in range(8)] + content[:1]), "y"), (3, None, "z")], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in rules.judge(df, model).collect()}
    assert got[1]["kept"] and 0.5 < got[1]["content_share"] < 1 and not got[2]["kept"] and not got[3]["kept"]


def test_toxicity_by_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    known = docs.join(labels.select("doc_id", "toxic").filter("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), "doc_id")
    n = toxicity.score(known, model).groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n}
    hit, miss, alarm = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit + miss > 50 and hit / (hit + miss) >= 0.85 and hit / (hit + alarm) >= 0.9


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op8_token_files"])
def test_odd_tables(spark, tmp_path, name):
    rows = [(3, "b", "x", 1), (3, "b", "x", 1), (None, None, None, None), (1, "", "x", 0), (2, "long " * 20_000, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, length int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.select("doc_id").filter(F.col("doc_id").isNull()).count() == 1 and out.filter("doc_id = 3").count() == 2
