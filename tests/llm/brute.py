"""Plain versions of the operators for small tables, and awkward rows to try them on."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

LONG = "the quick brown fox jumps over the lazy dog near the river bank and runs away again. "
ODD_DOCS = [
    (1, "Hello there, it's a test  of\n\n odd\tspacing!"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "12345 67!! ###"),
    (6, "日本語 テキスト é 😀 naïve"),
    (7, LONG * 3 + "one ending"),
    (8, LONG * 3 + "another ending"),
    (9, LONG * 3 + "one ending"),
    (9, LONG * 3 + "one ending"),
    (10, "x" * 30_000),
    (11, "ab " * 9_000),
    (12, "It's <|endoftext|> we'll see"),
    (None, "a row without an id, but with words in it"),
    (14, " ".join(f"word{i}" for i in range(4_000))),
    (15, "A\x1cB\x85C D"),
]
SCHEMA = "doc_id long, text string"


def odd_docs(spark, extra=True):
    """The awkward rows with columns whose names the operators use themselves."""
    rows = [(d, t, "en" if d and d % 2 else None, "web", len(t or ""), "x", 1.5) for d, t in ODD_DOCS]
    df = spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long, component_id string, score double")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars long")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeats(rows, length=100):
    """(n_bytes, n_removed, n_spans, sha of what is kept) per text, in the order given."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), sha(kept)))
    return out


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, linked):
    """Smallest id reachable for each position; ``linked`` gives pairs of positions."""
    at = list(range(len(ids)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            lo, hi = (a, b) if ids[a] <= ids[b] else (b, a)
            at[hi] = lo
    return [ids[find(i)] for i in range(len(ids))]
