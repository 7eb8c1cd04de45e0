"""Encoding by a sentencepiece BPE model file, with every piece traced to bytes of the source.

The model file is read as it is. Normalisation walks the compiled character map (a double-array
trie): at each place the longest prefix that the map knows is replaced, else one character stays,
and for every normalised byte the source bytes it came from are recorded. Merges run on the
normalised text and each piece is projected back through that record.

Where the map is empty, spaces stay and no piece reaches over a space, normalised words are
independent: each distinct word is merged once and remembered, and its ids, piece ends and byte
counts are joined per text. Any other model takes the general path. Null texts are empty.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

from pyspark.sql import DataFrame

from .common import id_and_text, kept, rows_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message; groups do not occur."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(b, i)
            value = b[i : i + n]
            i += n
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: trie size, double-array units, replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found


class PieceModel:
    """A BPE model file: vocabulary, normaliser, encoder and decoder."""

    def __init__(self, path: str, limit: int = 700_000, longest: int = 64):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        blob, self.dummy, self.trim, self.escape, self.model_type, self.suffix = b"", True, True, True, 1, False
        self.unk_surface = " ⁇ "
        with open(path, "rb") as f:
            data = f.read()
        for n, v in _fields(data):
            if n == 1:
                m = dict(_fields(v))
                self.pieces.append(m[1].decode())
                self.scores.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
                self.kinds.append(m.get(3, NORMAL))
            elif n == 2:
                for k, x in _fields(v):
                    self.model_type = x if k == 3 else self.model_type
                    self.suffix = bool(x) if k == 24 else self.suffix
                    self.unk_surface = x.decode() if k == 44 else self.unk_surface
            elif n == 3:
                for k, x in _fields(v):
                    blob = x if k == 2 else blob
                    self.dummy = bool(x) if k == 3 else self.dummy
                    self.trim = bool(x) if k == 4 else self.trim
                    self.escape = bool(x) if k == 5 else self.escape
        if self.model_type != 2:
            raise ValueError("not a BPE model")
        if self.suffix:
            raise ValueError("white space as a suffix is not supported")
        self.map = CharacterMap(blob)
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.merges = {p: (-self.scores[i], i) for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.unk = self.kinds.index(UNKNOWN)
        self.user = [p for p, k in zip(self.pieces, self.kinds) if k == USER]
        self.unused = {p for p, k in zip(self.pieces, self.kinds) if k == UNUSED}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.decimal = [str(i).encode() for i in range(len(self.pieces))]
        apart = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = not blob and self.escape and not self.trim and not self.user and not self.unused and not any(apart.search(p) for p in self.pieces)
        # plain words stand apart from the signs after them, where no piece joins a letter and a sign
        letters, signs = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?*%$&#|()"
        joined = re.compile(f"[{letters}][{signs}]")
        line = "" if any("\n" in p for p in self.pieces) else "\n"  # no piece reaches over a line's end either
        word = "" if any(joined.search(p) for p in self.pieces) else f"[ {SPACE}]*[{letters}]+(?=[{signs}]+(?:[ {SPACE}{line}]|\\Z))|"
        self.cut = re.compile(f"{word}[ {SPACE}]+[^ {SPACE}{line}]*|[^ {SPACE}{line}]+" + (f"|{line}+" if line else ""))
        self.rank = {p: r[0] for p, r in self.merges.items()}
        self.limit, self.longest = limit, longest
        self.known: dict[str, tuple[bytes, bytes]] = {}

    # --- normalisation ---------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text and, for each of its characters, first and end byte of its source."""
        data = text.encode()
        out, starts, ends = [], [], []
        space = SPACE if self.escape else " "

        def put(s: str, a: int, b: int) -> None:
            for c in s:
                out.append(space if c == " " else c)
                starts.append(a)
                ends.append(b)

        at, steps = 0, []
        while at < len(data):
            user = next((u for u in sorted(self.user, key=len, reverse=True) if data.startswith(u.encode(), at)), None)
            hit = (len(user.encode()), user.encode()) if user else self.map.longest(data, at)
            if hit is None:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                hit = n, data[at : at + n]
            steps.append((hit[1].decode(errors="replace"), at, at + hit[0]))
            at += hit[0]
        if self.trim:
            while steps and steps[0][0] in ("", " "):
                steps.pop(0)
        if not steps:
            return "", [], []
        if self.dummy:
            put(" ", steps[0][1], steps[0][1])
        last_space = self.trim
        for s, a, b in steps:
            while self.trim and last_space and s.startswith(" "):
                s = s[1:]
            if s:
                put(s, a, b)
                last_space = self.trim and s.endswith(" ")
        if self.trim:
            while out and out[-1] == space:
                out.pop(), starts.pop(), ends.pop()
        return "".join(out), starts, ends

    # --- merges ----------------------------------------------------------------------

    def _merge(self, text: str) -> list[str]:
        """Pieces of a normalised text: the best-scored pair first, the leftmost of equals."""
        if self.user:
            parts = re.split("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")", text)
            symbols = [x for i, p in enumerate(parts) for x in ([p] if i % 2 else p)]
            frozen = [f for i, p in enumerate(parts) for f in ([True] if i % 2 else [False] * len(p))]
        else:
            symbols, frozen = list(text), [False] * len(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1] if n else []
        queue, made = [], {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and not frozen[a] and not frozen[b]:
                whole = symbols[a] + symbols[b]
                rank = self.merges.get(whole)
                if rank is not None:
                    heapq.heappush(queue, (rank[0], a, b, whole))
                    if whole in self.unused:
                        made[whole] = (symbols[a], symbols[b])

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, whole = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != whole:
                continue
            symbols[a], symbols[b] = whole, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])

        def apart(p: str) -> list[str]:
            return [x for q in made[p] for x in apart(q)] if p in made and p in self.unused else [p]

        return [x for s in symbols if s is not None for x in apart(s)]

    def _ids_of(self, text: str, starts: list[int], ends: list[int]) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of the pieces; an unknown piece becomes its bytes, or one unknown id for a run."""
        out, at = [], 0
        for p in self._merge(text):
            a, b = starts[at], ends[at + len(p) - 1]
            at += len(p)
            i = self.ids.get(p)
            if i is not None and self.kinds[i] not in (CONTROL, UNKNOWN, BYTE):
                out.append((i, a, b))
            elif self.bytes[0] is not None:
                raw = p.encode()
                whole = b - a == len(raw)
                out += [(self.bytes[c], a + k if whole else a, a + k + 1 if whole else b) for k, c in enumerate(raw)]
            elif out and out[-1][0] == self.unk:
                out[-1] = self.unk, out[-1][1], b
            else:
                out.append((self.unk, a, b))
        return out

    def _short(self, symbols: list[str]) -> list[str]:
        """The merges of ``_merge`` for few symbols: the best neighbours are looked for in a list."""
        get, none = self.rank.get, float("inf")
        ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                ranks[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _word(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and source bytes of each piece of one independent chunk."""
        if len(chunk) <= 48 and SPACE not in chunk:
            found = self._short(list(chunk.replace(" ", SPACE)))
            ids = [self.ids.get(p, 0) for p in found]
            if all(self.kinds[i] == NORMAL for i in ids):
                sizes = [len(p.encode()) - 2 * p.count(SPACE) for p in found]
                return array("I", ids).tobytes(), array("I", sizes).tobytes()
        ends, at = [], 0
        for c in chunk:
            at += len(c.encode())
            ends.append(at)
        rows = self._ids_of(chunk.replace(" ", SPACE), [0, *ends[:-1]] if ends else [], ends)
        return struct.pack(f"<{len(rows)}I", *[r[0] for r in rows]), struct.pack(f"<{len(rows)}I", *[r[2] - r[1] for r in rows])

    def encode(self, text: str):
        """(ids, first bytes, end bytes) as arrays; spans are half-open and refer to the UTF-8 source."""
        import numpy as np

        if not text:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.by_word:
            rows = np.array(self._ids_of(*self.normalise(text)), np.int64).reshape(-1, 3)
            return rows[:, 0].astype(np.uint32), rows[:, 1], rows[:, 2]
        if len(self.known) > self.limit:
            self.known = {}
        parts = []
        for chunk in self.cut.findall(" " + text if self.dummy else text):
            got = self.known.get(chunk)
            if got is None:
                got = self._word(chunk)
                if len(chunk) <= self.longest:
                    self.known[chunk] = got
            parts.append(got)
        ids = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
        ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), "<u4"), dtype=np.int64)
        if self.dummy:
            ends = ends - 1  # the space put in front has no source
        starts = np.concatenate([[0], ends[:-1]])
        return ids, np.maximum(starts, 0), np.maximum(ends, 0)

    # --- decoding --------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.unk_surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")).encode()

    def decode(self, ids) -> str:
        """Text of the ids: control ids vanish, bytes join to characters (each wrong byte becomes U+FFFD), the space put in front goes."""
        ids = list(ids)
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
        data = b"".join(map(self.surface.__getitem__, ids))
        if first is not None and (self.dummy or self.trim) and self.kinds[ids[first]] not in (UNKNOWN, BYTE) and data.startswith(b" "):
            data = data.lstrip(b" ") if self.trim else data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _each_wrong_byte(data)


def _each_wrong_byte(data: bytes) -> str:
    import codecs

    codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))
    return data.decode(errors="one_by_one")


def encode_spans(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of each text and their half-open byte spans in it."""

    def work(batches):
        import pyarrow as pa

        m = kept(("pieces", model), lambda: PieceModel(model))
        for docs, texts in rows_of(batches, 1 << 20, as_bytes=False):
            rows = [m.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in range(3)]], ["doc_id", "ids", "begins", "ends"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "doc_id long, ids array<long>, begins array<long>, ends array<long>")


def digests(df: DataFrame, model: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (source bytes inside the pieces' spans): encode, then decode the ids."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        m = kept(("pieces", model), lambda: PieceModel(model))
        for docs, texts in rows_of(batches, as_bytes=False):
            out = []
            for doc, t in zip(docs, texts):
                ids, begins, ends = m.encode(t)
                ids = ids.tolist() + ([] if end_id is None else [end_id])
                text = m.decode(ids)
                out.append((doc, len(ids), hashlib.sha256(b" ".join(map(m.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), int(np.sum(ends - begins))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
