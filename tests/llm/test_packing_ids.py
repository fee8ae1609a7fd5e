import zlib

import numpy as np

from tesserae.llm import packing
from tesserae.llm.queries_packing import tokenizer_path


def test_ids_are_those_of_the_library(spark):
    """Added tokens' literals, and runs of white space too long for a backtracking pattern."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    run = 1_000_100
    texts = ["a <|endoftext|> b", "a<|endoftext|><|endoftext|>", "a <|endoftext| b", "a" + " " * run + "b", "a" + "\n" * run + "b <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = set()
    for d, text in enumerate(texts):
        x = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        want |= {(d, k, s, n, zlib.crc32(x[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(x)))}
    assert {tuple(r) for r in packing.pieces(docs, tokenizer_path()).collect()} == want


def test_ids_of_all_characters_and_tokens():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}1{c} .{c}!  {c} <|endoftext|>{c}\n" for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    texts += [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())]
    texts += [" <|endoftext|> ", "  <|endoftext|><|endoftext|>  x", "<|endoftext|", "z" + " " * packing.LONG_RUN + "z"]
    assert [s for s in texts if encode(s) != t.encode(s, add_special_tokens=False).ids] == []
