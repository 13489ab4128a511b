import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from zetaflow.llm.exact_dedup import exact_dedup
from zetaflow.llm.mixing import MAX_EPOCHS, mix, mix_counts, permute, targets
from zetaflow.llm.packing import WordIds, default_tokenizer, pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, piece int, run int, rank int, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("piece_rows", [2, 500])
def test_exact_dedup_against_brute_force(spark, keep, piece_rows):
    rows = [(i, "copy", "a") for i in range(40)] + [(100, None, "a"), (101, "", "b"), (None, "copy", "a"), (None, "lone", None), (7, "copy", "a"), (50, "Copy", "a"), (51, "x" * 200_000, "a"), (52, "x" * 200_000 + "y", "a")]
    got = exact_dedup(frame(spark, rows), keep=keep, piece_rows=piece_rows).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = {t: (min if keep == "min" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        assert not r.kept or r.doc_id == r.keep_id


def test_exact_dedup_empty_and_carry(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    out = exact_dedup(frame(spark, [(1, "a", "s"), (2, "a", "s")]), carry=True).filter("kept").select("row.*")
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and out.count() == 1


@pytest.mark.parametrize("blocks", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation_is_one_to_one(blocks):
    keys = [11, 22, 33, 44]
    got = permute(np.arange(blocks), blocks, keys)
    assert sorted(got) == list(range(blocks))
    assert list(permute(got, blocks, keys, back=True)) == list(range(blocks))


def test_targets_are_capped_and_reshared():
    got = targets([10, 1000, 0, 90], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 1100) < 1e-9 and got[3] == 270
    assert targets([], []) == [] and targets([5], [1]) == [5]


def test_mix_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), str(rng.choice(["a", "b", "c", "d"]))) for i in range(200)]
    rows += [(500, None, "a"), (501, "one", None), (None, "two words", "b"), (502, "v " * 20_000, "tiny"), (3, "again again", "c"), (3, "again again", "c")]
    docs = frame(spark, rows)
    got = mix_counts(docs, block_words=64).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_counts(docs, block_words=64).collect()))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names]
    goal = dict(zip(names, targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= MAX_EPOCHS * r["size"]
        taken[r.target, r.source_size] += r.taken
    assert {k[0] for k in taken} == set(goal.values())
    for (target, _), words in taken.items():
        assert abs(words - target) <= 1
    texts = mix(docs, block_words=64).collect()
    per_doc = defaultdict(int)
    for r in texts:
        per_doc[r.doc_id] += len(r.text.split())
    for r in got:
        if r.doc_id not in (3, None):
            assert per_doc[r.doc_id] == r.taken
    assert mix_counts(frame(spark, [])).count() == 0
    assert mix_counts(frame(spark, [(1, None, "a")])).first().taken == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    ids = WordIds(default_tokenizer())
    for text in ["", "Hello, WORLD it's 42!!", "tab\tand\x0bfeed\x0cé é́ x", "a\x1cb\xa0c d  İI ΑΣ ς", "<|endoftext|> x<|startoftext|>y", "x" * 5000, "don't  I'll\n\n'S 'sa"]:
        for _ in range(2):
            assert list(np.frombuffer(ids(text), "<u4")) == t.encode(text, add_special_tokens=False).ids


def test_remembered_words_take_little_memory():
    ids = WordIds(default_tokenizer())
    for lo in range(0, 400_000, 1000):
        ids(" ".join(f"w{i}" for i in range(lo, lo + 1000)))
    assert len(ids.cache) <= 201_000


def test_tasks_give_freed_memory_back():
    from pathlib import Path

    from zetaflow.llm.common import tidy

    def held() -> int:
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    last = []

    def run(batches):
        for n in batches:
            blocks = [bytes(range(100)) * 1000 for _ in range(n)]
            last.append(bytes(100_000))  # what lies above keeps the allocator from shrinking its heap
            yield len(blocks), held()

    rows = list(tidy(run)(iter([1000, 10])))
    assert [n for n, _ in rows] == [1000, 10] and held() < rows[0][1] - 60


def test_pack_is_a_partition_of_all_ids_without_padding(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "delta's", "99"], int(rng.integers(0, 1500)))), "a") for i in range(120)]
    rows += [(500, None, "a"), (501, "long " * 30_000, "a"), (None, "null id", "a"), (3, "twice", "b"), (3, "twice", "b")]
    got = pack(frame(spark, rows).repartition(3)).collect()
    ids = WordIds(default_tokenizer())
    expect = defaultdict(list)
    for i, t, _ in rows:
        expect[i].append(ids(t or "") + b"\x02\0\0\0")
    for i, all_ids in expect.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        if len(all_ids) == 1:
            at = 0
            for start, length, crc in pieces:
                assert start == at and crc == zlib.crc32(all_ids[0][start * 4 : (start + length) * 4])
                at += length
            assert at == len(all_ids[0]) // 4
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length, r.tier))
    for parts in seqs.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier <= 4096 and at & (at - 1) == 0
    assert pack(frame(spark, [])).count() == 0
