"""Token counts, word BPE and token files against the library itself."""

from __future__ import annotations

import hashlib
import random
import zlib
from array import array
from collections import Counter

import pyarrow as pa
import pytest
from helpers import BYTE, SF, WORD, empty_docs, odd_docs

from pyspark.sql import functions as F

from seqsearch.llm import chunks, token_counts, token_files, word_bpe


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "The", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "123", ",", "...", "!!", "<|endoftext|>", " ", "　", "\x00", "\x1c", "日本", "é", "İ", "ﬁ", "word", "\r\n", "_", "🙂", "ª", "µ", "ǆ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def by_pieces(texts, most, encoder):
    """Ids of texts, put together from their pieces'."""
    out = [[] for _ in texts]
    for owner, part, at in chunks.groups(pa.array(texts, pa.string()), most):
        found, codes = chunks.distinct(part, at)
        assert b"".join(found[c] for c in codes) == part.tobytes()
        values = encoder.values(found)
        for o, c in zip(owner.tolist(), codes.tolist(), strict=True):
            out[o] += values[c]
    return out


@pytest.mark.parametrize("most", [chunks.GROUP, 1000, 40, 7])
def test_pieces_encode_as_the_whole(most):
    """Groups of many texts, and groups so small that texts are cut into several."""
    texts = [*random_texts(1500), None, ""]
    expected = [e.ids for e in chunks.load(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert by_pieces(texts, most, chunks.PieceEncoder(BYTE, list)) == expected


def test_counts_and_ids():
    texts = [*random_texts(1500), None, ""]
    expected = [e.ids for e in chunks.load(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.array(texts, pa.string())
    assert token_counts.counts(BYTE, column).tolist() == [len(x) for x in expected]
    for some in (column, column.slice(700, 300), column.slice(0, 0), pa.array(["", None])):
        made = list(token_files.encode(BYTE, "<u2", some, 2))
        ids, at, ends = [], 0, []
        for part, stops in made:
            ids += part.tolist()
            ends += (stops + at).tolist()
            at += len(part)
        assert [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [[*expected[texts.index(t)], 2] for t in some.to_pylist()]


def test_small_memory_changes_nothing():
    texts = random_texts(300, 5) * 2
    small, large = chunks.PieceEncoder(BYTE, list, held=5), chunks.PieceEncoder(BYTE, list)
    for t in texts:
        assert by_pieces([t], chunks.GROUP, small) == by_pieces([t], chunks.GROUP, large)
    assert len(small.known) + len(small.known.old) < len(large.known)


def test_counts_of_odd_rows(spark):
    docs = odd_docs(spark)
    tokenizer = chunks.load(BYTE)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, BYTE).collect())
    expected = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(tokenizer.encode(r["text"] or "").ids), n > 512) for r in docs.collect())
    assert got == expected
    assert token_counts.token_counts(empty_docs(spark), BYTE).collect() == []


def test_counts_with_other_libraries(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in random_texts(200) if "\x00" not in t]
    assert token_counts.counts(path, pa.array(texts)).tolist() == [len(model.encode(t)) for t in texts]
    assert token_counts.counts(WORD, pa.array(texts)).tolist() == [len(e.ids) for e in chunks.load(WORD).encode_batch(texts, add_special_tokens=False)]


def digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("block", [word_bpe.BLOCK, 20_000, 1])
def test_word_bpe(spark, block):
    """One block a task, some, and one for each row."""
    tokenizer = chunks.load(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(random_texts(200), 10_000)), "doc_id long, text string"))
    got = Counter(tuple(r) for r in word_bpe.encode_decode(docs, WORD, block=block).collect())
    assert got == Counter((r["doc_id"], *digests(tokenizer, r["text"])) for r in docs.collect())


def test_every_word_is_encoded_once_and_every_block_is_found(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs(spark), allowMissingColumns=True).select("doc_id", "text")
    words = {w for r in docs.collect() for w in (r["text"] or "").encode().split()}
    asked = word_bpe.distinct_words(docs.select("text"), 3, 20_000)
    found = [w for r in asked.collect() for w in bytes(r["words"]).split(b" ")]
    assert set(found) == words and len(found) > len(words)
    assert {w: len({r["bucket"] for r in asked.collect() if w in bytes(r["words"]).split(b" ")}) for w in list(words)[:20]} == dict.fromkeys(list(words)[:20], 1)
    made, encoder = [], word_bpe.WordEncoder(WORD)
    known = chunks.Held(lambda ws: [made.append(w) or i for w, i in zip(ws, encoder.ids(ws), strict=True)], 1 << 28)
    for r in asked.collect():
        known.know(bytes(r["words"]).split(b" "))
    assert sorted(made) == sorted(words)
    word_bpe.write_blocks(word_bpe.encode_words(asked.repartitionById(3, "bucket"), WORD, 3), f"file://{tmp_path}", 3)
    n = 0
    for rows in docs.select("text").toArrow().to_batches():
        for block in word_bpe.blocks(iter([rows]), 0, 20_000):
            _, _, own = word_bpe.split(block.column(0))
            found = word_bpe.find_block(f"file://{tmp_path}", "<u2", 0xFFFF, own, 3)
            if found:  # the driver's batches are not the tasks', so that some blocks are others
                n += 1
                expected = encoder.ids(chunks.as_bytes(own))
                assert found[1].tobytes() == b"".join(expected) and found[0].tolist() == [len(x) // 4 for x in expected]
    assert n
    assert word_bpe.find_block(f"file://{tmp_path}", "<u2", 0xFFFF, pa.array(["no", "such", "block"]), 3) is None


def test_blocks_do_not_depend_on_batches():
    rng = random.Random(4)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 3, 50, 400]) for _ in range(300)]
    column = pa.array(texts, pa.string())
    for most in (1, 100, 1000, 10**6):
        ways = []
        for size in (1, 7, 300):
            batches = [pa.RecordBatch.from_arrays([column.slice(i, size)], names=["text"]) for i in range(0, 300, size)]
            ways.append([t.num_rows for t in word_bpe.blocks(iter(batches), 0, most)])
        assert ways[0] == ways[1] == ways[2] and sum(ways[0]) == 300


def test_a_block_that_is_not_found_is_encoded_in_place(spark):
    docs = odd_docs(spark).select(F.col("doc_id").alias("id"), "text")
    tokenizer = chunks.load(WORD)
    got = Counter(tuple(r) for r in word_bpe._assemble(docs, f"file:///tmp/no-such-folder-{random.random()}", WORD, 4, False, word_bpe.BLOCK).collect())
    assert got == Counter((r["id"], *digests(tokenizer, r["text"])) for r in docs.collect())


def test_word_bpe_ids_round_trip(spark):
    docs = odd_docs(spark).where("doc_id < 12 and doc_id <> 5")
    made = word_bpe.encode_decode(docs, WORD, ids=True)
    tokenizer = chunks.load(WORD)
    for r in word_bpe.decode(made, WORD).join(made, "doc_id").collect():
        assert r["decoded"] == tokenizer.decode(r["ids"], skip_special_tokens=False)
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"]
    assert word_bpe.encode_decode(empty_docs(spark), WORD, ids=True).collect() == []


def test_token_files(spark, tmp_path):
    docs = odd_docs(spark)
    tokenizer = chunks.load(BYTE)
    out = token_files.write(docs, BYTE, end_id=2, out=f"file://{tmp_path}/t", parts=3)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    start, expected = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), array("I", ids).tobytes()))
        start += len(ids)
    got = sorted(map(tuple, token_files.read(spark, out).collect()), key=lambda x: x[1])
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == expected
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.read_digests(spark, out).collect()}
    assert crc == {(a, b): zlib.crc32(d) for a, b, c, d in expected}
    assert token_files.read(spark, token_files.write(empty_docs(spark), BYTE, 2)).collect() == []


def test_token_files_keep_the_smallest_id_and_spread_nulls(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(-(2**63), "least"), (2**63 - 1, None)] + [(7, f"seven {i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = token_files.write(docs, BYTE, end_id=2, parts=4)
    got = sorted(map(tuple, token_files.read(spark, out).select("start", "doc_id").collect()))
    assert [i for _, i in got] == [None] * 300 + [-(2**63)] + [7] * 300 + [2**63 - 1]
    assert max(r["n_docs"] for r in spark.read.parquet(f"{out}/index").collect()) < 300
    with pytest.raises(TypeError):
        token_files.write(docs.select(F.lit("a").alias("doc_id"), "text"), BYTE, end_id=2)


def test_a_part_that_is_missing_is_an_error(spark, tmp_path):
    docs = odd_docs(spark).where("doc_id < 6")
    out = token_files.write(docs, BYTE, end_id=2, out=str(tmp_path / "t"), parts=2)
    next((tmp_path / "t").glob("*.ids")).unlink()
    with pytest.raises(Exception, match="differ"):
        token_files.read(spark, out).collect()
