"""Registered queries that SQL can't express, on the given tables, against plain loops over the same rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tidewright.llm import queries, url_filter


@pytest.fixture(scope="module")
def texts(sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    return {d: t or "" for d, t in zip(docs.doc_id.tolist(), docs.text)}


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6(spark, sf, texts):
    ids = sorted(texts)
    marks = [fingerprint(texts[d]) for d in ids]
    root = dict(zip(ids, ids))
    changed = True
    while changed:  # least id reachable, by sweeps over all pairs
        changed = False
        for i, a in enumerate(ids):
            for j in range(i):
                if (marks[i] ^ marks[j]).bit_count() <= 4 and root[a] != root[ids[j]]:
                    root[a] = root[ids[j]] = min(root[a], root[ids[j]])
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash_near_dedup"](spark, sf).collect()}
    assert got == {d: (f"{m:016x}", root[d]) for d, m in zip(ids, marks)}
    assert len(set(root.values())) < len(ids)


def test_op8(spark, sf, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, text in texts.items():
        ids = own.encode_ordinary(text)
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op8_byte_bpe"](spark, sf).collect()} == want


def test_op4_and_op9(spark, sf, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for d in sorted(texts):
        ids = library.encode(texts[d], add_special_tokens=False).ids + [0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_token_shards"](spark, sf).collect()} == want
    library.encode_special_tokens = True  # op9 takes added tokens in a text as ordinary text
    counts = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op9_token_counts"](spark, sf).collect()} == counts


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def test_op10(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet", columns=["page_id", "url"])
    weights = url_filter.train(url_filter.labelled_urls())
    want = {}
    for page, url in zip(pages.page_id.tolist(), pages.url):
        _, found, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest if found else "", maxsplit=1)[0]
        path = re.split("[?#]", (rest if found else "")[len(host) :], maxsplit=1)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith("" if r == "com/" else r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        model = "block" if url_filter.probability(weights, pa.array([host]), pa.array([path]))[0] >= 0.5 else "allow"
        want[page] = (host, path, rule, RULES[rule] if rule else model)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.QUERIES["op10_url_filter"](spark, sf).collect()}
    assert got == want


def test_url_model_on_hosts_held_back():
    """Hosts are split before anything is fitted: every fifth by hash, in five turns, so each host is judged by a model that never saw it.

    Measured: precision 0.923, recall 0.400 of 60 among 150 (two of 90 clean hosts blocked). The bounds guard that, and are no claim to more.
    """
    table = url_filter.labelled_urls()
    turn = table.host.map(lambda h: zlib.crc32(h.encode()) % 5)
    said = np.zeros(len(table))
    for t in range(5):
        rest, held = table[turn != t], table[turn == t]
        assert not set(rest.host) & set(held.host)
        said[turn == t] = url_filter.probability(url_filter.train(rest), pa.array(held.host), pa.array(held.path))
    block, truth = said >= 0.5, table.label.to_numpy() == 1
    precision, recall = (block & truth).sum() / max(1, block.sum()), (block & truth).sum() / truth.sum()
    assert precision >= 0.85 and recall >= 0.35
