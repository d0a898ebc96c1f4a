"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from waymark.llm import byte_bpe, chat, crf, jaccard, packing, rules, substrings, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_JSON, BYTE_RANKS, WORD_JSON = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gámma", "d", "the", "of,", "x.", "日本", "don't", "42", "###"]
    out = [None, "", " ", "one two", "one two", "\n\n", "  a  b\n\n c\x1c d\xa0e  ", "z" * 3000, " ".join(rng.choices(vocabulary, k=400))]
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(12)]
    base = rng.choices([f"w{i}" for i in range(500)], k=200)
    for _ in range(6):
        copy = list(base)
        for i in rng.sample(range(200), 3):
            copy[i] = "edited" + str(rng.random())
        out.append(" ".join(copy))
    passage = rng.choices([f"p{i}" for i in range(300)], k=70)
    for k in range(4):
        out.append(" ".join([f"a{k}{i}" for i in range(30)] + passage + [f"b{k}{i}" for i in range(20)]))
    out.append(" ".join(["again"] * 120))
    out.append(" ".join(["again"] * 130))
    return out


def frame(spark, values=None, extra=True):
    values = texts() if values is None else values
    rows = [(i, t, f"s{i}", i, "x") for i, t in enumerate(values)]
    schema = "doc_id long, text string, own string, length int, ids string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text")


def docs():
    return dict(enumerate(texts()))


def test_byte_bpe(spark):
    ranks = byte_bpe.load_ranks(BYTE_RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark)
    coded = byte_bpe.encode(df, BYTE_RANKS, P.PATTERN)
    assert {"own", "length", "ids"} <= set(coded.columns)
    back = {r["doc_id"]: r for r in byte_bpe.decode(coded, BYTE_RANKS, P.PATTERN).collect()}
    for d, t in docs().items():
        assert list(back[d]["ids"]) == own.encode_ordinary(t or "") and bytes(back[d]["decoded"]) == (t or "").encode()
    assert byte_bpe.digest(df.limit(0), BYTE_RANKS, P.PATTERN).count() == 0


def test_merge_replay_word_by_word():
    ranks = byte_bpe.load_ranks(BYTE_RANKS)
    m = byte_bpe.MergeReplay(ranks, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdethe in-==aaaa\xc3\xa9") for _ in range(rng.randint(1, 16))) for _ in range(1500)]
    for w, found in zip(words, m.replay(words)):
        assert np.frombuffer(found, np.int32).tolist() == m.scalar(w) == own._encode_single_piece(w)


def test_token_files(spark):
    library = Tokenizer.from_file(BYTE_JSON)
    library.encode_special_tokens = True
    rows = {r["doc_id"]: r for r in token_files.read(token_files.write(frame(spark), BYTE_JSON), keep_ids=True).collect()}
    start = 0
    for d, t in docs().items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        r = rows[d]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd = spark.createDataFrame([(None, "x"), (3, "a"), (3, "b"), (3, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["start"]) for r in token_files.read(token_files.write(odd, BYTE_JSON)).collect()) == [(-1, 0), (3, 2), (3, 4), (3, 6)]
    assert token_files.read(token_files.write(odd.limit(0), BYTE_JSON)).count() == 0


def test_word_codec():
    rng = np.random.default_rng(1)
    for k in range(200):
        n = int(rng.integers(0, 400))
        ids = (2.0 ** rng.integers(0, rng.integers(1, 33), n) * rng.random(n)).astype(np.uint64)
        if k % 3 == 0 and n:
            ids = np.repeat(ids, rng.integers(1, 90, n))
        if k % 50 == 1:
            ids = np.append(ids, np.uint64(2**59 + 5))
        assert (token_files.decode_words(token_files.encode_words(ids)) == ids).all()
    with pytest.raises(ValueError):
        token_files.unpack_block(b"S8B2" + bytes(20))


def test_packing(spark):
    library = Tokenizer.from_file(WORD_JSON)
    library.encode_special_tokens = True
    rows = packing.pack(frame(spark), WORD_JSON, capacity=64).collect()
    ids = {d: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in docs().items()}
    pieces = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in pieces.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert Counter(r["doc_id"] for r in rows) == {d: -(-len(x) // 64) for d, x in ids.items()}
    assert packing.pack(frame(spark).limit(0), WORD_JSON).count() == 0


def fewest(sizes, capacity):
    """The true optimum, by trying all ways to put the largest piece somewhere."""
    best = [len(sizes)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + rest[0] <= capacity:
                put(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
        put(rest[1:], [*bins, rest[0]])

    put(sorted(sizes, reverse=True), [])
    return best[0]


def test_bin_completion_is_optimal_on_small_problems():
    rng = random.Random(2)
    cases = [([6, 6, 5, 5, 4, 4], 15), ([7, 6, 6, 5, 4, 3, 2, 2], 12)]
    cases += [([rng.randint(3, 20) for _ in range(11)], 24) for _ in range(40)]
    for sizes, capacity in cases:
        plan = packing.bin_completion(dict(Counter(sizes)), capacity)
        used = Counter()
        for content, n in plan:
            assert sum(k * m for k, m in content) <= capacity
            for k, m in content:
                used[k] += m * n
        assert used == Counter(sizes) and sum(n for _, n in plan) == fewest(sizes, capacity)
        assert packing.lower_bound(dict(Counter(sizes)), capacity) <= fewest(sizes, capacity)
    assert packing.bin_completion({}, 10) == []


def removed(width):
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in docs().items()}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        keys = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        for i, k in enumerate(keys):
            if first.get(k, d) < d:
                gone[i : i + width] = [True] * width
        for k in keys:
            first.setdefault(k, d)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("width", [50, 8])
def test_substrings(spark, width):
    got = substrings.dedup(frame(spark), width)
    assert "own" in got.columns
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == removed(width)


def test_substrings_odd_rows(spark):
    w = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, w), (2, w), (2, w), (2, "short"), (1, None), (5, w)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substrings.dedup(df).collect())
    assert got == [(-1, 60, 0), (1, 0, 0), (2, 1, 0), (2, 60, 0), (2, 60, 0), (5, 60, 60)]
    assert substrings.dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup(df, 5)


def shingle_sets(values):
    out = {}
    for d, t in values.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies():
    """Chains and crowds of near copies around the threshold, at many sizes."""
    rng = random.Random(9)
    out = []
    for size in (1, 4, 5, 6, 9, 12, 20, 40, 90, 300, 900):
        base = [f"{size}w{rng.randint(0, 10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, max(1, size // 50), max(1, size // 45), max(1, size // 40)):
            copy = list(base)
            for i in rng.sample(range(size), min(size, edits)):
                copy[i] = f"e{rng.random()}"
            out.append(" ".join(copy))
    crowd = [f"c{i}" for i in range(120)]
    for k in range(40):
        copy = list(crowd)
        for i in rng.sample(range(120), 2):
            copy[i] = f"k{k}{i}"
        out.append(" ".join(copy).upper() if k % 2 else " ".join(copy))
    return texts() + out


def test_jaccard(spark):
    values = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, values)).collect()}
    assert got == components(shingle_sets(dict(enumerate(values))))


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "A B c d e f"), (None, "q"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.join(df).collect())
    assert got == [(-1, 1, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2), (7, 0, 7)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 5, 8, 13, 30, 64, 100, 400, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            k = int(rng.integers(0, max(1, len(a) // 9) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - k], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < 80 * (len(a) + len(b) - common):
                continue
            for share in (0.0, 0.5, 1.0):
                frequent = np.sort(rng.permutation(a)[: int(share * len(a))])
                assert set(jaccard.signatures(a, frequent)) & set(jaccard.signatures(b, frequent))


def brute_counts(t):
    w = WORD.findall(t)
    times = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rule_counts(spark):
    values = texts() + ["a | b\na | b\n\n \na | b <c>\n" * 20]
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(values))], "doc_id long, quality int")
    model = rules.train(frame(spark, values), labels)
    got = rules.judge(frame(spark, values), model)
    for r in got.collect():
        c = brute_counts(values[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r["base_failed"] and r["kept"])
    assert rules.judge(frame(spark, values).limit(0), model).count() == 0
    with pytest.raises(ValueError):
        rules.train(frame(spark, values), labels.limit(0))


def test_field_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    emission, moves, length = rng.normal(size=(6, 5)), rng.normal(size=(2, 2)), np.array([5, 3, 1, 4, 2, 5])
    on, _, total = crf.marginals(emission, length, moves)
    states = crf.viterbi(emission, length, moves)
    for i, n in enumerate(length):
        scores = {s: sum(emission[i, t] * s[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(s, s[1:])) for s in product((0, 1), repeat=int(n))}
        z = np.logaddexp.reduce(list(scores.values()))
        assert total[i] == pytest.approx(z)
        for t in range(n):
            assert on[i, t] == pytest.approx(sum(np.exp(v - z) for s, v in scores.items() if s[t]))
        assert tuple(states[i, :n]) == max(scores, key=scores.get)


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\e \\l [x] <s>", "", None, "plain\n", "</s", "<s>[INST] user 0 [/INST]hi</s>", "a\\", "[/INST]"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", hard[(c + t) % len(hard)]) for c in range(9) for t in range(4)]
    rows += [(20, 0, "odd [role] </s>", "x"), (20, 1, None, "y"), (21, 0, "assistant", "tie"), (21, 0, "assistant", "tie"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", __import__("pyspark").sql.functions.lit(1))
    made = chat.format_conversations(df)
    full = {r["conv_id"]: r for r in made.collect()}
    short = {r["conv_id"]: r for r in chat.digest(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in full[c]["turns"]] == [x[1:] for x in turns]
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        r = short[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["formatted_chars"] == len(full[c]["formatted"])
    assert full[21]["formatted"].count("</s>") == 2 and chat.format_conversations(df.limit(0)).count() == 0


def test_base64_is_the_rank_file():
    line = open(BYTE_RANKS, "rb").readline().split()
    assert byte_bpe.load_ranks(BYTE_RANKS)[base64.b64decode(line[0])] == int(line[1])
