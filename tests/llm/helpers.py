from __future__ import annotations

import public_tokenizers

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key string, h long, row string"
LONG = "lorem ipsum dolor " * 20_000 + "x" * 300_000
TEXTS = [None, "", "   ", "\n\n", "one", "a  b \n c", "é à\n\nü ß", "x<|endoftext|> y", "don't  stop", "\t tab nbsp 　 wide", "#$% | || !!", "one two three one two three one two three\nsame\nsame", LONG, LONG]


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a shared id, and columns with clashing names."""
    rows = [(i, t, None, None if i % 3 else f"s{i % 2}", None, "id", None, "key", 1, "row") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "en", "s0", 1, None, 1, None, None, None), rows[5], rows[5], (5, "another text of five", "en", "s1", 1, None, 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
