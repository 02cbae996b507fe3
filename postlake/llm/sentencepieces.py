"""SentencePiece BPE by a prefix table.

For every prefix of a text there is exactly one last token of its encoding. An automaton over all
pieces names the pieces that end at a position; the last token is the one that may stand beside the
last token of the prefix before it. The table of last tokens is filled from left to right, and the
ids are read off it backwards.

Two tokens may stand side by side when the merges that built them would never have joined symbols
across their border. A token's merges are known from its own encoding, so each token has two spines:
the symbols that stood at its right edge over the course of the merges, and those at its left edge,
each with the ranks at which it appeared and vanished. If a right-edge and a left-edge symbol that
lived at the same time form a piece that would have merged before either vanished, the pair can't
occur. Equal ranks merge from the left.

No piece reaches over a border between characters that stand side by side in no piece, so a text is
cut at blanks and then at such borders, and parts met again are taken from a bounded memory.

Null text: as empty (begin and end ids only). Characters without a piece become UTF-8 byte pieces.
One output row per input row; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
#: Parts kept per worker, each of at most PART_CHARS characters.
MEMORY_PARTS = 1_000_000
PART_CHARS = 40
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NEVER = 1 << 60


class PieceTable:
    """Pieces, their spines and the automaton of one model file."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model)  # reads the file; encoding below is ours
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_ids, special = set(self.bytes), set()
        for i in range(size):
            if library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                special.add(i)
        self.piece = {names[i]: i for i in range(size) if i not in byte_ids and i not in special}
        scores = sorted({library.get_score(i) for i in self.piece.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {i: place[library.get_score(i)] for i in self.piece.values()}
        self.surface = [b""] * size
        for name, i in self.piece.items():
            self.surface[i] = name.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.length = [len(x.decode("utf-8", "replace")) for x in self.surface]
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        if any(BLANK in name.lstrip(BLANK) for name in self.piece):
            raise ValueError("texts are cut before blanks, but a piece of this model holds a blank behind another character")
        self.beside = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.piece.items():
            if self._spines(name, i):
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.fit: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}

    def _spines(self, name: str, whole: int) -> bool:
        """Merge the piece from its characters and keep its edges over time; False if it never forms."""
        parts = list(name)
        right, left = [(parts[-1], -1)], [(parts[0], -1)]
        while len(parts) > 1:
            options = [(self.rank[p], k) for k in range(len(parts) - 1) if (p := self.piece.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                return False
            when, k = min(options)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if k == len(parts) - 1:
                right.append((parts[-1], when))
            if k == 0:
                left.append((parts[0], when))
        for spine, kept in ((right, self.right), (left, self.left)):
            ends = [born for _, born in spine[1:]] + [_NEVER]
            kept[whole] = tuple((symbol, born, gone) for (symbol, born), gone in zip(spine, ends))
        return True

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        key = a << 20 | b
        known = self.fit.get(key)
        if known is None:
            known = self.fit[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        for r, r_born, r_gone in self.right[a]:
            for s, s_born, s_gone in self.left[b]:
                if r_born <= s_gone and s_born < r_gone:
                    joined = self.piece.get(r + s)
                    if joined is not None and self.rank[joined] < r_gone and self.rank[joined] <= s_gone:
                        return False
        return True

    def last_tokens(self, text: str) -> list[int]:
        """For each position the last token of the prefix that ends there; -1 after a character without a piece."""
        last = [-1] * len(text)
        fit = self.fit
        for at, (token, length) in self.automaton.iter(text):
            if last[at] >= 0:
                continue
            start = at - length
            if start < 0:
                last[at] = token
            elif (before := last[start]) >= 0:
                known = fit.get(before << 20 | token)
                if known or known is None and self.fits(before, token):
                    last[at] = token
            elif text[start] not in self.piece:  # a character that merges with nothing
                last[at] = token
        return last

    def tokens(self, text: str) -> bytes:
        """The ids of a part as unsigned 32-bit integers, read backwards from its last prefix."""
        last, out, at, length = self.last_tokens(text), [], len(text) - 1, self.length
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= length[token]
            else:
                out.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8", "surrogatepass")))
                at -= 1
        out.reverse()
        return array("I", out).tobytes()

    def borders(self, part: str) -> list[str]:
        """The part cut at every place where no piece holds the two characters side by side; plain words stay whole."""
        if part[1:-1].isalpha() and part[-2:] in self.beside:
            return [part]
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.beside]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def part(self, part: str) -> bytes:
        """The ids of a blank-led part; parts met before come from memory."""
        known = self.parts.get(part)
        if known is None:
            runs = self.borders(part)
            known = self.tokens(part) if len(runs) == 1 else b"".join(map(self.part, runs))  # runs have no borders: no deeper call
            if len(part) <= PART_CHARS:
                if len(self.parts) >= MEMORY_PARTS:
                    self.parts.clear()
                self.parts[part] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, begin and end included, as unsigned 32-bit integers of this machine's order."""
        body = b""
        if text:
            if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
                parts = self.blank_runs(text.replace(" ", BLANK).split(BLANK))
            else:
                parts = (BLANK + text.replace(" ", " " + BLANK)).split(" ")
            known = self.parts
            body = b"".join([known.get(p) or self.part(p) for p in parts])
        return array("I", [self.begin]).tobytes() + body + array("I", [self.end]).tobytes()

    @staticmethod
    def blank_runs(pieces: list[str]) -> list[str]:
        """Each word with the blanks before it (one is put before the text); blanks at the end stand alone."""
        out, blanks = [], 0
        for w in pieces:
            blanks += 1
            if w:
                out.append(BLANK * blanks + w)
                blanks = 0
        if blanks:
            out.append(BLANK * blanks)
        return out

    def decode(self, packed: bytes) -> str:
        """The text of the ids: pieces joined, byte runs as UTF-8, the added blank dropped."""
        ids = array("I")
        ids.frombytes(packed)
        raw = b"".join(map(self.surface.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def piece_table(model: str) -> PieceTable:
    return PieceTable(model)


def little_endian(packed: bytes) -> bytes:
    ids = array("I")
    if ids.itemsize != 4:
        raise RuntimeError("unsigned ints of this platform don't have 32 bits")
    if memoryview(array("H", [1])).tobytes() == b"\x01\x00":
        return packed
    ids.frombytes(packed)
    ids.byteswap()
    return ids.tobytes()


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text; keep_ids adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            counts, id_digests, text_digests, all_ids = [], [], [], []
            for text in batch.column(1):
                packed = table.encode(text.as_py())
                counts.append(len(packed) // 4)
                id_digests.append(hashlib.sha256(little_endian(packed)).hexdigest())
                text_digests.append(hashlib.sha256(table.decode(packed).encode("utf-8")).hexdigest())
                if keep_ids:
                    all_ids.append(array("I", packed).tolist())
            columns = [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
