"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, the leftmost first among equals,
and merges from its top. The vocabulary decides where texts can be cut: no merge ever crosses the
front of a blank mark if no piece has one after another character, so a word is encoded once in each
worker process. Texts are checked against the sentencepiece library as they pass.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from pathlib import Path

from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from labreports.llm.common import add_columns

BLANK = "▁"
_KEPT_WORDS = 800_000
_SHORT = 32
_NEVER = float("-inf")


class MergeVocabulary:
    """Pieces, scores and byte ids of a merge-type model with byte fallback."""

    def __init__(self, model: bytes):
        self.library = library = SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(k) for k in range(size)]
        plain, self.byte_ids, self.texts = [], {}, []
        for k, piece in enumerate(self.pieces):
            if library.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(k):
                self.texts.append(b"")
            elif library.is_unknown(k):
                self.texts.append(" ⁇ ".encode())
            else:
                plain.append(k)
                self.texts.append(piece.replace(BLANK, " ").encode("utf-8"))
        self.ids = {self.pieces[k]: k for k in plain}
        self.scores = {self.pieces[k]: library.get_score(k) for k in plain}
        self.end = library.eos_id()
        self.digits = [str(k) for k in range(size)]
        if len(self.byte_ids) != 256 or library.normalize(" a  b ") != f"{BLANK * 2}a{BLANK * 2}b{BLANK}":
            raise ValueError("expected byte fallback and text taken as it is behind one blank mark")
        if any(library.is_unused(k) for k in plain):
            raise ValueError("expected a vocabulary without unused pieces")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("expected pieces that don't reach over a blank mark or line break")
        self.words: dict[str, list[int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one stretch of text that no merge crosses the ends of."""
        if len(word) <= _SHORT:
            return self._named(self._merge_short(word))
        return self._named(self._merge_long(word))

    def _merge_short(self, word: str) -> list[str]:
        """The agenda is a list in text order: its maximum is cheaper to find than to keep on top."""
        get, symbols = self.scores.get, list(word)
        agenda = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = max(agenda)
            if best == _NEVER:
                break
            k = agenda.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = get(symbols[k] + symbols[k + 1], _NEVER)
            if k:
                agenda[k - 1] = get(symbols[k - 1] + symbols[k], _NEVER)
        return symbols

    def _merge_long(self, word: str) -> list[str]:
        """The agenda is a heap; entries whose symbols have changed since are passed over."""
        scores, n = self.scores, len(word)
        symbols: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        agenda = []
        for k in range(n - 1):
            score = scores.get(word[k : k + 2])
            if score is not None:
                agenda.append((-score, k, k + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = a + b, None
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                joined = a + b + symbols[far]
                score = scores.get(joined)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, far, len(joined)))
            near = before[left]
            if near >= 0:
                joined = symbols[near] + a + b
                score = scores.get(joined)
                if score is not None:
                    heapq.heappush(agenda, (-score, near, left, len(joined)))
        return [symbol for symbol in symbols if symbol is not None]

    def _named(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; one that is no piece becomes its bytes."""
        ids = [self.ids.get(symbol, -1) for symbol in symbols]
        if -1 not in ids:
            return ids
        out: list[int] = []
        for symbol, found in zip(symbols, ids):
            out += [found] if found >= 0 else [self.byte_ids[x] for x in symbol.encode("utf-8")]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the end id."""
        out: list[int] = []
        if text:
            known = self.words
            marked = BLANK + text.replace(" ", BLANK)
            for word in self._stretches(marked):
                found = known.get(word)
                if found is None:
                    found = self.merge(word)
                    if len(known) >= _KEPT_WORDS:
                        known.clear()
                    if len(word) <= 64:
                        known[word] = found
                out += found
        out.append(self.end)
        return out

    @staticmethod
    def _stretches(marked: str) -> list[str]:
        if BLANK * 2 in marked or "\x00" in marked:
            return re.findall(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+", marked)
        parts = marked.replace(BLANK, f"\x00{BLANK}").replace("\n", "\x00\n\x00").split("\x00")
        return [part for part in parts if part]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; the blank mark in front of the text is dropped."""
        texts = self.texts
        data = b"".join([texts[k] for k in ids])
        first = next((k for k in ids if texts[k]), None)
        if first is not None and self.pieces[first].startswith(BLANK):
            data = data[1:]
        return data.decode("utf-8", "replace")

    def check(self, texts: list[str], ids: list[list[int]], decoded: list[str]) -> None:
        """Compare with the library, both ways."""
        for text, own, back in zip(texts, ids, decoded):
            expected = self.library.encode(text, add_eos=True, num_threads=1)
            if own != expected or back != self.library.decode(expected):
                raise ValueError(f"differs from the sentencepiece library: {text[:200]!r}")

    def digest(self, ids: list[int]) -> str:
        digits = self.digits
        return hashlib.sha256(" ".join([digits[k] for k in ids]).encode()).hexdigest()


def encode_pieces(
    docs: DataFrame,
    model_path: str | Path,
    with_ids: bool = True,
    with_decoded: bool = False,
    check_every: int = 1,
) -> DataFrame:
    """Encode and decode every whole text; add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and
    on request ``ids`` and ``decoded``. The columns of ``docs`` other than the text stay (those with
    the names of results are replaced).

    Null counts as empty, and an empty text has the end id only. Every text, or every
    ``check_every``-th of an Arrow batch, is also given to the sentencepiece library, both ways, and
    any difference stops the job; 0 turns this off. Each row is handled by itself, without a shuffle. The model file (half
    a megabyte) is read on the driver and travels with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"model": Path(model_path).read_bytes()})
    results = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    results += ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    def prepare():
        # A worker process keeps the value of a broadcast, so all its tasks share the words met.
        kept = shared.value
        if "vocabulary" not in kept:
            kept["vocabulary"] = MergeVocabulary(kept["model"])
        vocabulary = kept["vocabulary"]

        def encoded(texts: list[str]) -> list[list]:
            ids = list(map(vocabulary.encode, texts))
            decoded = list(map(vocabulary.decode, ids))
            if check_every:
                vocabulary.check(texts[::check_every], ids[::check_every], decoded[::check_every])
            digests = [hashlib.sha256(text.encode("utf-8")).hexdigest() for text in decoded]
            made = [list(map(len, ids)), list(map(vocabulary.digest, ids)), digests]
            return [*made, *[ids] * with_ids, *[decoded] * with_decoded]

        return encoded

    return add_columns(docs, "text", results, prepare, drop_source=True)
