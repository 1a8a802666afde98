"""Texts of added tokens get the ids that the library gives."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quietline.llm import tokens
from quietline.llm.queries import tokenizer_path


def test_added_tokens_as_the_library_has_them(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "a b c", "a  b", None]
    library = Tokenizer.from_file(tokenizer_path())
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert len(want[0]) == 5
    ids, sizes = tokens.Encoder(tokenizer_path(), 2).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == np.concatenate(want).tolist() and sizes.tolist() == [len(w) for w in want]
    rows = tokens.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(w), zlib.crc32(w.tobytes())) for w in want]
