import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from articleflow.llm import catalog

SF = "/root/testdata/sf0.001"


def test_counts_packing_and_codec_equal_the_libraries(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in catalog.op3_token_counts(spark, SF).collect():
        want = (len(texts[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 512)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == want

    held, places = {}, {}
    for r in catalog.op4_packing(spark, SF).collect():
        full = np.array([*ids[r.doc_id], 1], "<u4")
        assert r.doc_tokens == len(full)
        assert r.ids_crc32 == zlib.crc32(full[r.start : r.start + r.length].tobytes())
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for found, total in [(v, len(ids[i]) + 1) for i, v in held.items()] + [(v, None) for v in places.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= 2048
    assert held.keys() == texts.keys()

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in catalog.op9_byte_bpe(spark, SF).collect():
        want = codec.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
