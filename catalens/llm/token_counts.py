"""Token counts under a unigram model, by dynamic programming shared along a trie of pre-tokens.

Pre-tokens are the words of a text, each behind a word-begin mark. The best segmentation of a word into vocabulary pieces needs, at each
character, only the forward scores of the characters before; words with a common prefix share them. Within a task the
distinct words of a piece of text are walked in sorted order, which is the depth-first walk of their trie: the
stack holds the forward scores of the current path, a new word goes back to the shared prefix and only extends from there, and
the token count at a word's last node is stored for all its occurrences. Documents are never shuffled: only distinct words
within a piece of text are scored, and the sums stay with their documents.

Scores: the vocabulary's order is a rank, so a piece of rank r has log-probability -log(r + 1) up to a constant (Zipf). Characters
outside the vocabulary cost one token per UTF-8 byte at a score below any piece.

Defined results: null or blank texts have 0 tokens and score 0; ties between segmentations go to fewer tokens; repeated rows count
alike; an empty table gives an empty result. Columns of the input stay, result columns replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from catalens.llm.common import raw_texts, slices

MARK = "▁"
PIECE_BYTES = 2 << 20


def vocabulary(model_file: str) -> dict[str, float]:
    """Piece → score from a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(r + 1) - total for r, piece in enumerate(pieces)}


def piece_trie(scores: dict[str, float]) -> dict:
    """Nested dicts by character; the score of a piece stands under the empty string."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def forward(words: list[str], trie: dict, byte_score: float) -> tuple[list[int], list[float]]:
    """Token count and score of each of the sorted words. Level k of the stack: best score and count of the path's first
    k characters, and the unfinished pieces there as (score before, count before, trie node)."""
    best, counts, open_pieces = [0.0], [0], [[]]
    path = ""
    out_counts, out_scores = [], []
    for word in words:
        shared = 0
        limit = min(len(path), len(word))
        while shared < limit and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], counts[shared + 1 :], open_pieces[shared + 1 :]
        for c in word[shared:]:
            n = len(c.encode())
            score, count = best[-1] + n * byte_score, counts[-1] + n
            going = []
            for s, k, node in (*open_pieces[-1], (best[-1], counts[-1], trie)):
                node = node.get(c)
                if node is not None:
                    going.append((s, k, node))
                    own = node.get("")
                    if own is not None and (s + own > score or (s + own == score and k + 1 < count)):
                        score, count = s + own, k + 1
            best.append(score)
            counts.append(count)
            open_pieces.append(going)
        path = word
        out_counts.append(counts[-1])
        out_scores.append(best[-1])
    return out_counts, out_scores


def count_tokens(docs: DataFrame, scores: dict[str, float], text: str = "text") -> DataFrame:
    """The documents with n_pretokens, n_tokens and token_score (log-probability of the best segmentation)."""
    results = ("n_pretokens", "n_tokens", "token_score")
    docs = docs.select(*[c for c in docs.columns if c not in results])
    shared = docs.sparkSession.sparkContext.broadcast((piece_trie(scores), min(scores.values(), default=0.0) - 10.0))  # a vocabulary, not data

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, byte_score = shared.value
        for piece in slices(batches, text, PIECE_BYTES):
            split = [t.split() for t in raw_texts(piece.column(piece.schema.get_field_index(text)))]
            sizes = np.array([len(x) for x in split], dtype=np.int64)
            flat = np.empty(int(sizes.sum()), dtype=object)
            flat[:] = [w for x in split for w in x]
            codes, distinct = pd.factorize(flat)
            named = [MARK + w.decode("utf-8", "replace") for w in distinct]
            order = sorted(range(len(named)), key=named.__getitem__)
            found_counts, found_scores = forward([named[i] for i in order], trie, byte_score)
            counts, totals = np.zeros(len(named), np.int64), np.zeros(len(named))
            counts[order], totals[order] = found_counts, found_scores
            text_of = np.repeat(np.arange(len(split)), sizes)
            n_tokens = np.bincount(text_of, weights=counts[codes], minlength=len(split)).astype(np.int64) if len(codes) else np.zeros(len(split), np.int64)
            score = np.bincount(text_of, weights=totals[codes], minlength=len(split)) if len(codes) else np.zeros(len(split))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(sizes), pa.array(n_tokens), pa.array(score)], names=[*piece.schema.names, *results])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(count, f"{columns}, n_pretokens long, n_tokens long, token_score double")
