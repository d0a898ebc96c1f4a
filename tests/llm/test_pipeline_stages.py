"""Each stage after the models against brute force on that stage's own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm._common import materialise, table

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in (text or "").translate(str.maketrans(dict.fromkeys(SPACE, " "))).split(" ") if w]


def one_of_each(texts):
    sets = {}
    for d, t in texts.items():
        w = [x.translate(LOWER) for x in words(t)]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = sorted((group[a], group[b]))[::-1]
                group = {d: new if g == old else g for d, g in group.items()}
    return {d: t for d, t in texts.items() if group[d] == d}


def without_repeats(texts, width=50):
    first, out = {}, {}
    for d in sorted(texts):
        w, gone = words(texts[d]), set()
        for i in range(len(w) - width + 1):
            if first.setdefault(tuple(w[i : i + width]), d) < d:
                gone.update(range(i, i + width))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[d]
    return out


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    long = [d for d in sorted(texts) if len(words(texts[d])) > 200]
    more = [(10**6 + i, texts[d] + f" extra{i}", d) for i, d in enumerate(long[:8])]  # near copies
    more += [(2 * 10**6 + i, f"new{i} start {' '.join(words(texts[d])[40:110])} and new{i} end", d) for i, d in enumerate(long[8:20])]  # a passage
    more = spark.createDataFrame(more, "doc_id long, text string, of long").join(docs.drop("text", "n_chars").withColumnRenamed("doc_id", "of"), "of")
    now = docs.unionByName(more.selectExpr("*", "cast(length(text) as long) as n_chars").select(*docs.columns))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
        now = materialise(stage(spark, now, sf), "test")
    seen["end"] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert seen["substring dedup"] == one_of_each(seen["n-gram Jaccard join"]) != seen["n-gram Jaccard join"]
    assert seen["end"] == without_repeats(seen["substring dedup"]) != seen["substring dedup"]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in seen["end"].items()}
    packed, held = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect(), defaultdict(list)
    covered = defaultdict(list)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert {d: Counter(x) for d, x in covered.items()} == {d: Counter(range(len(x))) for d, x in ids.items()}
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(held) >= -(-sum(map(len, ids.values())) // 4096)
