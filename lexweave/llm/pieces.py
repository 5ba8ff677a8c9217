"""SentencePiece (BPE) encoding and decoding by a table over prefixes.

A BPE encoding is the only sequence of pieces with the right text in which all neighbours are
compatible, that is, encoding the two texts together gives these two pieces again. So each prefix
of a text has one last piece: that piece which ends there and which is compatible with the last
piece of the prefix before it. An automaton over the vocabulary gives the pieces that end at each
place, the table takes the compatible one, and the ids come out backwards from the end. The work
is linear in the text, whatever it holds.

Whether two pieces are compatible is found by merging the characters of the two, a text of a few
dozen characters at most, and remembered. The model's normaliser must leave text alone but for the mark for a space and, if
the model says so, one such mark in front; load() refuses another model.

Where no piece of the vocabulary goes across a place (a mark for a space after another character),
no merge can, and the text is cut there. The cuts are words mostly, and each distinct one is encoded
once by a worker while the memory for it lasts.

Defined results: a null text is encoded like the empty one; lone characters outside the vocabulary
become bytes or the unknown id. Very long texts are encoded whole, repeated rows alike; extra columns are not read, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from lexweave.llm.common import rowwise

SPACE = "▁"
#: Words with their ids, in each of two generations, and pairs of pieces that a worker remembers at most.
REMEMBERED, PAIRS = 200_000, 600_000


class Vocabulary:
    """What a model file says, in plain data that can be sent to executors."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        #: text -> (id, score) of what can be merged
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not special[i]}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.text_of = {i: sp.id_to_piece(i) for i in range(n)}
        # What a control piece or the unknown piece is decoded to is the model's choice.
        self.surface = {i: sp.decode([i]) for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        probe = sp.encode("a", out_type=str)
        self.prefix = SPACE if "".join(probe).startswith(SPACE) else ""
        for text, want in ((" a", " a"), ("a  b ", "a  b "), ("\ta\n", "\ta\n"), ("Ａé", "Ａé")):
            if sp.decode(sp.encode(text)) != want:
                raise ValueError("a model whose normaliser changes the text isn't supported")


#: A run of marks with what follows it, or what stands before the first mark.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Words(dict):
    """The ids of each word as bytes, remembered for shorter ones. When there are too many, they become the older generation, and those of it
    that are met again come back; the older one before is forgotten."""

    def __init__(self, encode):
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            ids = self.encode(text)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) > 64:
                return found
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[text] = found
        return found


class Encoder:
    """The automaton and what is remembered."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.words = Words(self.ids)
        self.letters = {p for p in v.pieces if len(p) == 1}
        #: Texts and lengths of the pieces by a number, the first being that of no piece; ids by the same number.
        self.texts = ["", *v.pieces]
        self.sizes = [len(t) for t in self.texts]
        self.id_of = [0, *(i for i, _ in v.pieces.values())]
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for k, text in enumerate(self.texts[1:], 1):
            self.automaton.add_word(text, k)
        self.automaton.make_automaton()
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in v.pieces)

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE as defined: the neighbours whose union has the best score, the leftmost first, become one."""
        symbols = list(symbols)
        pieces = self.v.pieces
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = pieces.get(symbols[i] + symbols[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the texts of both gives the two pieces again; without a left one (0), whether right's text gives right."""
        key = left * len(self.texts) + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            a, b = self.texts[left], self.texts[right]
            self.compatible[key] = known = self.merge(list(a + b)) == ([a, b] if left else [b])
        return known

    def known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        # The table: the last piece of each prefix, -1 where there is none yet.
        last = [-1] * (len(text) + 1)
        last[0] = 0
        known, sizes, n = self.compatible.get, self.sizes, len(self.texts)
        for at, piece in self.automaton.iter(text):
            end = at + 1
            if last[end] < 0 and (left := last[end - sizes[piece]]) >= 0:
                fit = known(left * n + piece)
                if self.fits(left, piece) if fit is None else fit:
                    last[end] = piece
        ids, at, id_of = [], len(text), self.id_of
        while at:
            piece = last[at]
            ids.append(id_of[piece])
            at -= sizes[piece]
        ids.reverse()
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of any text with marks for spaces: runs of known characters by the table, the others as bytes."""
        if self.letters.issuperset(text):
            return self.known(text)
        out: list[int] = []
        start, pieces = 0, self.v.pieces
        for i, c in enumerate(text):
            if c not in pieces:
                if start < i:
                    out += self.known(text[start:i])
                start = i + 1
                if self.v.bytes:
                    out += [self.v.bytes[b] for b in c.encode("utf-8", "replace")]
                else:
                    out.append(self.v.unknown)
        if start < len(text):
            out += self.known(text[start:])
        return out

    def encode(self, text: str) -> bytes:
        """All ids as little-endian 32-bit integers, with those for begin and end."""
        v = self.v
        body = b""
        if text:
            marked = v.prefix + text.replace(" ", SPACE)
            body = b"".join(map(self.words.__getitem__, WORD.findall(marked) if self.cuts else [marked]))
        return v.begin.to_bytes(4, "little") + body + v.end.to_bytes(4, "little")


class Decoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.byte_of = {i: b for b, i in v.bytes.items()}
        # Texts of pieces that need no care: plain ones, and control pieces without text.
        self.plain = {i: t.replace(SPACE, " ") for i, t in v.text_of.items() if i not in v.surface and i not in self.byte_of}
        self.easy = self.plain | {i: "" for i, t in v.surface.items() if not t}

    def decode(self, ids: memoryview | list[int]) -> str:
        """The text of ids: pieces with marks as spaces, one leading space dropped if the model adds it,
        runs of bytes as UTF-8 in which each byte that fits nowhere becomes U+FFFD."""
        try:
            text = "".join(map(self.easy.__getitem__, ids))
            return text[1:] if self.v.prefix and text[:1] == " " else text
        except KeyError:
            pass
        out: list[str] = []
        run = bytearray()
        plain, first = self.plain, bool(self.v.prefix)
        for i in ids:
            p = plain.get(i)
            if p is not None:
                if run:
                    out.append(as_text(run))
                    run = bytearray()
                if first:
                    p = p[1:] if p[:1] == " " else p
                    first = False
                out.append(p)
            elif i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
            else:
                if run:
                    out.append(as_text(run))
                    run = bytearray()
                out.append(self.v.surface[i])
        if run:
            out.append(as_text(run))
        return "".join(out)


def as_text(run: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[i : i + n]).decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row; with keep=True also ids (array) and decoded.

    The model file is read on the driver; its vocabulary (as large as that file) goes to the executors.
    Each batch of rows is encoded on its own, without a shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def start():
        # Kept with the broadcast value, so that the tasks of a worker share what is remembered.
        v = vocabulary.value
        if not hasattr(v, "tools"):
            v.tools = Encoder(v), Decoder(v)
        encoder, decoder = v.tools

        def run(texts: list) -> list:
            rows = []
            for t in texts:
                data = encoder.encode(t or "")
                ids = memoryview(data).cast("I")
                back = decoder.decode(ids)
                row = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())
                rows.append((*row, np.frombuffer(data, np.uint32).astype(np.int32), back) if keep else row)
            return list(zip(*rows)) or [()] * (5 if keep else 3)

        return run

    return rowwise(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else ""), start)
