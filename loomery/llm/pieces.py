"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies (operator 10).

A sequence of tokens is the merge encoding of a text exactly if each two neighbours, joined and merged anew, come out
as the same two tokens. So a text is encoded from left to right by backtracking: an Aho-Corasick automaton gives the
longest token at each place; it is taken if it is compatible with the token before (a re-merge of the two, remembered);
else the next shorter token is tried; a place from which no token works is marked in a bit field and never tried again.

No token of these vocabularies reaches over the start of a run of word marks, and none holds a character outside the
vocabulary. Texts are cut there, and what comes between is encoded once and remembered, in a bounded store.

Memory of a worker: the vocabulary, the two stores (some tens of MB when full), and one text with its ids. A text
without spaces takes four bytes a character more while it is encoded.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from loomery.llm.common import REMEMBERED_CHARS, Remembered, with_made_columns

MARK = "▁"
#: Pairs of tokens that a worker remembers.
PAIRS = 150_000


class MergeEncoder:
    """Encoder and decoder of one model file. ``encode`` and ``decode`` agree with the sentencepiece library.

    For models with a dummy prefix, byte fallback, no normalisation and no user-defined pieces; others are refused.
    """

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown = library.unk_id()
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif library.is_control(i):
                self.silent.add(i)
            elif i != self.unknown:
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
        if not self.byte_of or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("only models with byte fallback whose pieces have word marks at their start alone")
        _refuse_normalising(library)
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.size = [len(p) for p in self.pieces]
        #: For each token the longest token that is a true beginning of it, or -1.
        self.shorter = [-1] * len(self.pieces)
        self.find = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.find.add_word(piece, i)
            self.shorter[i] = next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)
        self.find.make_automaton()
        self.pairs: list[dict[int, bool]] = []
        self._forget_pairs()
        self.runs: dict[int, list[str]] = {}
        self.special = frozenset(self.byte_of) | self.silent | {self.unknown}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        self.marked = Remembered(lambda word: self._encode_chunk(MARK + word))
        self.bare = Remembered(self._encode_chunk)

    # -- merging, the definition ---------------------------------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """The merge encoding by definition: again and again the best-scored pair, the leftmost of equals. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two ids, side by side, stay what they are; without one before (-1), whether the token comes out alone."""
        known = self.pairs[before].get(token)
        if known is None:
            if self.n_pairs >= PAIRS:
                self._forget_pairs()
            two = [self.pieces[before], self.pieces[token]] if before >= 0 else [self.pieces[token]]
            known = self.pairs[before][token] = self.merge("".join(two)) == two
            self.n_pairs += 1
        return known

    def _forget_pairs(self) -> None:
        # in place, as callers hold the list; the last entry is that of no token before
        self.pairs[:] = [{} for _ in range(len(self.pieces) + 1)]
        self.n_pairs = 0

    # -- backtracking --------------------------------------------------------------------------------------------
    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters with at most one word mark, at its start."""
        n, size, shorter, pairs = len(text), self.size, self.shorter, self.pairs
        # the longest token at each place; shorter ones follow from it
        longest = [-1] * n if n <= REMEMBERED_CHARS else array("i", [-1]) * n
        for end, i in self.find.iter(text):
            longest[end - size[i] + 1] = i
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            known = pairs[before]
            while token >= 0:
                if not dead[at + size[token]]:
                    fits = known.get(token)
                    if fits is None:
                        fits = self.compatible(before, token)
                        known = pairs[before]
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                if at == n:
                    return tokens
                before, token = token, longest[at]
            else:
                # what is held is the encoding of text[:at], the only one; nothing follows it, so no token ends here
                if not tokens:
                    raise ValueError("no encoding")
                dead[at] = 1
                last = tokens.pop()
                at -= size[last]
                before, token = (tokens[-1] if tokens else -1), shorter[last]

    def _run(self, n: int) -> list[str]:
        """Tokens of ``n`` word marks in a row: they grow from the left, as all their merges score alike."""
        if n not in self.runs:
            if len(self.runs) > 256:
                self.runs.clear()
            self.runs[n] = self.merge(MARK * n) if n <= 64 else self._long_run(n)
        return self.runs[n]

    def _long_run(self, n: int) -> list[str]:
        # the longest token of marks is finished at the left before anything else changes: it splits off
        head = self.merge(MARK * 64)[0]
        whole, rest = divmod(n - 64, len(head))
        return [head] * whole + self.merge(MARK * (64 + rest))

    # -- chunks --------------------------------------------------------------------------------------------------
    def _known_text(self, text: str) -> list[int]:
        """Ids of text made of known characters: marks at its start, if any, then none."""
        body = text.lstrip(MARK)
        n_marks = len(text) - len(body)
        if n_marks > 1:
            tail = self.backtrack(MARK + body) if body else [self.ids[MARK]]
            alone = tail[0] == self.ids[MARK]
            return [self.ids[t] for t in self._run(n_marks if alone else n_marks - 1)] + (tail[1:] if alone else tail)
        return self.backtrack(text)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of marks followed by text without marks."""
        known = self.known
        if known.issuperset(chunk):
            return tuple(self._known_text(chunk))
        out: list[int] = []
        start = 0
        for i, c in enumerate(chunk):
            if c not in known:
                if i > start:
                    out += self._known_text(chunk[start:i])
                out += [self.bytes[b] for b in c.encode()]
                start = i + 1
        if start < len(chunk):
            out += self._known_text(chunk[start:])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; none for an empty one."""
        out: list[int] = []
        if not text:
            return out
        if MARK in text:
            text = text.replace(MARK, " ")
        marked, bare = self.marked.__getitem__, self.bare.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                out += bare("\n")
            if "  " in line or (not k and line[:1] == " "):
                for chunk in _marked_chunks(line if k else " " + line):
                    out += self._encode_chunk(chunk)
            elif line or not k:
                words = line.split(" ")
                if k:
                    out += bare(words[0]) if words[0] else ()
                    words = words[1:]
                out.extend(chain.from_iterable(map(marked, words)))
        return out

    # -- decoding ------------------------------------------------------------------------------------------------
    def _surface(self, ids: list[int]) -> str:
        out: list[str] = []
        pending = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_utf8_or_replacements(bytes(pending)))
                pending.clear()
            if i is None or i in self.silent:
                continue
            out.append(" ⁇ " if i == self.unknown else self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, without the dummy prefix; bytes that aren't UTF-8 become U+FFFD each."""
        if self.special.isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
            return text[1:] if text[:1] == " " else text
        seen = [i for i in ids if i not in self.silent]
        text = self._surface(seen)
        return text[1:] if seen and seen[0] not in self.byte_of and seen[0] != self.unknown and text[:1] == " " else text

    def joined(self, ids: list[int]) -> str:
        """Ids as decimal text, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))


def _refuse_normalising(library) -> None:
    """Raise unless the model leaves texts as they are but for a dummy prefix and word marks."""
    for given, wanted in (("a", MARK + "a"), (" a  b ", f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"), ("\u00e9\ufb01\uff21\u2460e\u0301\t", f"{MARK}\u00e9\ufb01\uff21\u2460e\u0301\t")):
        if library.normalize(given) != wanted:
            raise ValueError("only models with a dummy prefix and no other normalisation")
    # user-defined pieces are found before any merge
    for i in range(library.get_piece_size()):
        if library.is_unused(i):
            raise ValueError("only models without unused pieces")


def _marked_chunks(line: str) -> Iterator[str]:
    """Chunks of a line with spaces: each starts with its marks."""
    marks = 0
    first, *rest = line.split(" ")
    if first:
        yield first
    for part in rest:
        marks += 1
        if part:
            yield MARK * marks + part
            marks = 0
    if marks:
        yield MARK * marks


def _utf8_or_replacements(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_ENCODERS: dict[str, MergeEncoder] = {}


def encoder(model_path: str) -> MergeEncoder:
    """The encoder of a model, made once in each Python worker."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = MergeEncoder(model_path)
    return _ENCODERS[model_path]


def _known(model_path: str):
    """Give the encoder where it is needed: in the tasks."""
    return lambda: encoder(model_path)


def encode_table(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>) to ``docs``: the tokens of the whole text. Null and empty texts have no ids.

    One row out for each row in, repeated rows too; a column ``ids`` of the input is replaced. Empty table: no rows.
    """
    return with_made_columns(
        docs, text, {"ids": "array<int>"}, _known(model_path), lambda tool, texts: {"ids": pa.array([tool.encode(x or "") for x in texts], pa.list_(pa.int32()))}
    )


def decode_table(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string) to a table of ids. Null ids give null; a column ``decoded`` of the input is replaced."""
    return with_made_columns(
        coded, ids, {"decoded": "string"}, _known(model_path), lambda tool, rows: {"decoded": pa.array([None if x is None else tool.decode(x) for x in rows], pa.string())}
    )


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): number of ids, digests of the ids and of the text decoded from them.

    Null and empty texts have no ids and the digests of nothing. Null and repeated ids are rows like others; other
    columns are left out. Texts of any length are encoded whole.
    """

    def made(tool: MergeEncoder, texts: list[str | None]) -> dict:
        n, ids, decoded = [], [], []
        for text in texts:
            found = tool.encode(text or "")
            n.append(len(found))
            ids.append(hashlib.sha256(tool.joined(found).encode()).hexdigest())
            decoded.append(hashlib.sha256(tool.decode(found).encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    return with_made_columns(docs.select("doc_id", "text"), "text", kinds, _known(model_path), made).select("doc_id", *kinds)


def op10_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """The contract of operator 10 over ``documents``."""
    return encode_digests(docs, model_path)


def encode_rows(docs: DataFrame, model_path: str) -> DataFrame:
    """Replace ``text`` of ``docs`` by ``ids`` (array<int>), ``n_tokens``, and ``same``: whether the ids decode to it.

    Word marks in a text count as spaces. Null and empty texts have no ids. Other columns are kept, those of the names
    above replaced; repeated rows stay as many; no rows: no rows.
    """

    def made(tool: MergeEncoder, texts: list[str | None]) -> dict:
        ids = [tool.encode(x or "") for x in texts]
        same = [tool.decode(found) == (x or "").replace(MARK, " ") for found, x in zip(ids, texts)]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "same": pa.array(same, pa.bool_())}

    kinds = {"ids": "array<int>", "n_tokens": "bigint", "same": "boolean"}
    return with_made_columns(docs, "text", kinds, _known(model_path), made, without=("text",))
