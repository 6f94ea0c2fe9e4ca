"""SentencePiece encoding and decoding: merge-type (BPE) pieces placed by backtracking.

A sequence of pieces is what merging by score makes of a text exactly if every piece is what merging makes of its own
text and every two neighbours stay apart when their joint text is merged anew. So the encoder walks a text with the
matches of an Aho-Corasick automaton, takes at each position the longest piece that is compatible with the piece before
it, goes back to shorter ones where none is, and marks positions from which no way leads on, so that none is tried twice.

Three kinds of text never take part in a merge with what is beside them and are cut off first: characters outside the
vocabulary (byte pieces stand for them), the border in front of a word's space mark (no piece has the mark after another
character), and runs of space marks. Runs are special: all their pieces have one score, so a run is merged leftmost first.

Nulls and empty texts have no ids and decode to the empty text. Repeated rows each get a row; extra columns are dropped
by `encode_documents`, which returns its own columns only.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyloom.llm.shared import per_text

SPACE = "▁"
#: Segments whose ids a worker remembers in each of two generations, and pairs of pieces; more or fewer change no result.
REMEMBERED = 250_000


class Codec:
    """Encoder and decoder over the pieces of one model file. Model files with user-defined pieces are refused."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.text: dict[int, str] = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i], self.id_of[piece], self.score[piece] = piece, i, sp.get_score(i)
        if len(self.byte_ids) != 256 or any(SPACE in p[1:] and p.strip(SPACE) for p in self.id_of):
            raise ValueError("a model with byte fallback and space marks at the front of pieces only is asked for")
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.known = {c for c in self.id_of if len(c) == 1}
        self.pairs: dict[int, bool] = {}
        self._table()
        #: Two characters that no piece has side by side never merge, so a text can be cut between them.
        self.beside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.parts: dict[str, list[int]] = {}
        self.ids = _Memory(self)

    def _table(self) -> None:
        """The automaton over the pieces that merging makes of their own text, and for each the longest such prefix."""
        self.automaton, self.shorter, self.length = ahocorasick.Automaton(), {}, {}
        standing = {p: i for p, i in self.id_of.items() if (p == SPACE or p.strip(SPACE)) and self.merged(p) == [i]}
        for piece, i in standing.items():
            self.automaton.add_word(piece, (len(piece), i))
            self.length[i] = len(piece)
            self.shorter[i] = next((standing[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in standing), -1)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[int]:
        """What merging by score, leftmost first among equals, makes of a text of known characters."""
        if len(text) > 40:
            return self._merged_long(text)
        sym, score = list(text), self.score
        while len(sym) > 1:
            best, where = -math.inf, -1
            for i in range(len(sym) - 1):
                found = score.get(sym[i] + sym[i + 1])
                if found is not None and found > best:
                    best, where = found, i
            if where < 0:
                break
            sym[where : where + 2] = [sym[where] + sym[where + 1]]
        return [self.id_of[s] for s in sym]

    def _merged_long(self, text: str) -> list[int]:
        """The same with a queue, for long runs."""
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        sym: list[str | None] = list(text)
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) < len(sym) and (both := sym[i] + sym[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if sym[i] is None or (j := right[i]) >= len(sym) or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j], right[i] = both, None, right[j]
            if right[j] < len(sym):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [self.id_of[s] for s in sym if s is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two pieces side by side stay as they are when their joint text is merged anew."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return found

    def backtrack(self, chunk: str) -> list[int]:
        """Ids of a text of known characters that has no space mark behind its first character."""
        n, length, shorter, pairs = len(chunk), self.length, self.shorter, self.pairs
        longest = {last - size: i for last, (size, i) in self.automaton.iter(chunk)}  # by start - 1; later ones are longer
        if length[longest[-1]] == n:
            return [longest[-1]]
        failed = bytearray(n + 1)
        out: list[int] = []
        pos, i = 0, longest[-1]
        while pos < n:
            while i >= 0:
                if not failed[pos + length[i]]:
                    if not out:
                        break
                    fits = pairs.get(out[-1] << 20 | i)
                    if fits or fits is None and self.compatible(out[-1], i):
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                pos += length[i]
                i = longest.get(pos - 1, -1)
            else:
                failed[pos] = 1
                last = out.pop()
                pos -= length[last]
                i = shorter[last]
        return out

    def part(self, chunk: str) -> list[int]:
        """Ids of known characters that may all merge."""
        if len(chunk) == 1 and chunk not in self.known:
            return [self.byte_ids[b] for b in chunk.encode()]
        return self.backtrack(chunk)

    def shared_part(self, chunk: str) -> list[int]:
        """The same, remembered, as words that are cut share parts; whole words are remembered as segments."""
        found = self.parts.get(chunk)
        if found is None:
            found = self.part(chunk)
            if len(chunk) <= 32:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[chunk] = found
        return found

    @lru_cache(maxsize=256)
    def run(self, n: int) -> tuple[int, ...]:
        return tuple(self.merged(SPACE * n)) if n else ()

    def segment(self, s: str) -> list[int]:
        """Ids of one piece of text as `cut` cuts it."""
        body = s.lstrip(SPACE)
        marks = len(s) - len(body)
        if not body:
            return list(self.run(marks))
        out: list[int] = []
        text, start, beside = SPACE + body if marks else body, 0, self.beside
        for at, two in enumerate(map(str.__add__, text, text[1:]), 1):
            if two not in beside:
                out += self.shared_part(text[start:at])
                start = at
        out += self.shared_part(text[start:]) if start else self.part(text)
        if marks > 1:
            alone = out[0] == self.id_of[SPACE]
            out = [*self.run(marks if alone else marks - 1), *out[alone:]]
        return out

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.cuts(text) for i in self.segment(s)]

    def surface(self, ids: list[int]) -> str:
        """The text of ids, space marks as they are; runs of byte pieces are read as UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.text.get(i, ""))
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The surface without the space mark that encoding puts in front."""
        text = self.surface(ids).replace(SPACE, " ")
        return text[1:] if ids and self.text.get(ids[0], "").startswith(SPACE) else text


class _Memory(dict):
    """The ids of a segment, joined by commas, by its text; `plain` has the decoded text, marks as they are, where it is
    not the segment itself.

    When it is full, it becomes the older generation, from which what is met again is taken over.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.plain, self.older, self.older_plain = codec, {}, {}, {}

    def __missing__(self, s: str) -> str:
        value = self.older.get(s)
        if value is None:
            ids = self.codec.segment(s)
            text = self.codec.surface(ids)
            value = ",".join(map(str, ids))
        else:
            text = self.older_plain.get(s, s)
        self[s] = value
        if text != s:
            self.plain[s] = text
        return value

    def tidy(self) -> None:
        if len(self) >= REMEMBERED:
            self.older, self.older_plain = dict(self), self.plain
            self.plain = {}
            self.clear()


@lru_cache(maxsize=2)
def codec_for(model: str) -> Codec:
    return Codec(model)


def digests(model: str, text: str) -> tuple[int, str, str]:
    """How many ids a text has, the SHA-256 of the ids, and that of the text decoded from them."""
    codec = codec_for(model)
    cuts = codec.cuts(text)
    codec.ids.tidy()
    ids = ",".join(map(codec.ids.__getitem__, cuts))
    plain = "".join(map(codec.ids.plain.get, cuts, cuts)).replace(SPACE, " ")[1:]  # the first piece starts with the mark put in front
    return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key, n_tokens, ids_sha256, decoded_sha256. No shuffle; memory is bounded by one slice of texts."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    work = per_text(text, [key], lambda t: digests(model, t), schema)
    return docs.select(key, text).mapInArrow(work, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_to_ids(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the key and its ids as array<int>, for writing training files."""
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])
    work = per_text(text, [key], lambda t: (codec_for(model).encode(t),), schema)
    return docs.select(key, text).mapInArrow(work, f"`{key}` long, ids array<int>")


def decode_ids(ids: DataFrame, model: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """Per row of ids (null: none): the key and the decoded text."""
    schema = pa.schema([(key, pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = codec_for(model)
        for b in batches:
            texts = [codec.decode(list(x or [])) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return ids.select(key, column).mapInArrow(run, f"`{key}` long, text string")
