"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Where the trie has no edge, the greedy
tokenizer would cut off the longest tokens of what it has read and go on with
the rest; that rest is the state's failure link, and how many tokens were cut
off is known beforehand. Both are compiled into one full transition table and
one table of popped-token counts, so a word's token count is a walk with one
step a byte and no pieces are built. All distinct words of a slice walk at
once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lodestone.llm.text_arrow import Words, slices, string_column

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(lines: list[bytes]) -> list[bytes]:
    """The tokens of a rank file: base64 and rank on each line."""
    return [base64.b64decode(x.split()[0]) for x in lines if x.strip()]


class LongestMatch:
    """Greedy longest-match counts over a vocabulary that holds every single byte."""

    def __init__(self, tokens: list[bytes]):
        root: dict = {}
        children, token, order = [root], [False], []
        for t in tokens:
            at = 0
            for c in t:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    token.append(False)
                at = nxt
            if at:
                token[at] = True
        if any(not (c in root and token[root[c]]) for c in range(256)):
            raise ValueError("the vocabulary must hold each of the 256 bytes as a token")
        n = len(children)
        step = np.zeros((n, 256), np.int32)
        pops = np.zeros((n, 256), np.uint8)
        fail, cut = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.rest = np.zeros(n, np.int32)
        for c, v in root.items():
            step[0, c] = v
        order, i = list(root.values()), 0
        for v in order:
            fail[v], cut[v] = 0, 1
        while i < len(order):
            v = order[i]
            i += 1
            # The failure link's row is complete: it is of smaller depth.
            row, popped = step[fail[v]].copy(), pops[fail[v]].astype(np.int32) + cut[v]
            for c, u in children[v].items():
                if token[u]:
                    fail[u], cut[u] = 0, 1
                else:
                    fail[u], cut[u] = row[c], popped[c]
                order.append(u)
            for c, u in children[v].items():
                row[c], popped[c] = u, 0
            if popped.max() > np.iinfo(pops.dtype).max:
                pops = pops.astype(np.int32)
            step[v], pops[v] = row, popped
            self.rest[v] = cut[v] + self.rest[fail[v]]
        self.step, self.pops = step, pops

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word."""
        if not words:
            return np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        longest = lengths[order]
        state, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        alive = len(words)
        for k in range(int(longest[0])):
            while alive and longest[alive - 1] <= k:
                alive -= 1
            c = data[start[:alive] + k]
            s = state[:alive]
            total[:alive] += self.pops[s, c]
            state[:alive] = self.step[s, c]
        total += self.rest[state]
        out = np.empty_like(total)
        out[order] = total
        return out


_built: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once in each worker."""
    if path not in _built:
        with open(SparkFiles.get(path.removeprefix("files:")) if path.startswith("files:") else path, "rb") as f:
            _built[path] = LongestMatch(read_vocabulary(f.readlines()))
    return _built[path]


def count_tokens(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text: id, n_words, n_bytes, n_tokens.

    Words are runs of non-white-space (ASCII white space); each is taken as
    its UTF-8 bytes after one space, as byte-level vocabularies have it, and
    cut greedily into the longest tokens. ``vocabulary`` is a rank file at
    the same path on every machine, or ``files:NAME`` for one shipped with
    ``addFile``. Null and empty texts count 0; repeated rows are kept, each
    with its own result; an empty input gives an empty result.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = string_column(part, "_text")
                words = Words(texts)
                each = automaton(vocabulary).counts([b" " + w.encode() for w in words.unique.to_pylist()])
                sums = np.concatenate([[0], np.cumsum(each[words.ids] if len(words.ids) else np.zeros(0, np.int64))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.array(words.counts.astype(np.int64)),
                        pc.cast(pc.binary_length(texts), pa.int64()),
                        pa.array((sums[words.start[1:]] - sums[words.start[:-1]]).astype(np.int64)),
                    ],
                    names=[id_col, "n_words", "n_bytes", "n_tokens"],
                )

    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_words bigint, n_bytes bigint, n_tokens bigint")
