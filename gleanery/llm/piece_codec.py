"""SentencePiece BPE encoding and decoding by backtracking over Aho-Corasick matches.

A sequence of pieces is the BPE encoding of their text if and only if every piece encodes to itself and every two
adjacent pieces stay apart when their joint text is merged. So a text is encoded left to right: take the longest piece
that starts here, has not led to a failed end, and is compatible with the piece before it; if none is left, mark the
position as failed, drop the last piece and try its next shorter one. Failed positions are the bits of an integer.
Merging itself only runs on texts of two pieces, and its verdict is remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gleanery.llm.common import kept, pieces, texts, tidy, tune
from gleanery.llm.segments import LETTER, PUNCT, SegmentCache, classes, cuts_to_segments

MARK = "▁"


class PieceCodec:
    """Encoder of one model file; equal to the library for models of type BPE with identity normalisation, a dummy
    prefix, kept white space and byte fallback, and checks that the model is one."""

    def __init__(self, path: str, max_pairs: int = 1_000_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.lib.serialized_model_proto())
        norm = model.normalizer_spec
        plain = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        self.ids, self.scores = {p: i for p, i, _ in plain}, {p: s for p, _, s in plain}
        self.bytes = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        chars = {c for p in self.ids for c in p}
        ok = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        ok &= not model.trainer_spec.treat_whitespace_as_suffix and all(c in self.ids for c in chars) and "\n" not in chars
        ok &= not any(MARK in p.lstrip(MARK) for p in self.ids) and all(p.type in (p.NORMAL, p.UNKNOWN, p.CONTROL, p.BYTE) for p in model.pieces)
        if not ok:
            raise ValueError("not a byte-fallback BPE model with identity normalisation")
        self.auto = ahocorasick.Automaton()
        for p in self.ids:
            self.auto.add_word(p, p)
        self.auto.make_automaton()
        #: ASCII punctuation that follows a letter in no piece: never merged with it
        self.apart = np.array([chr(b) not in {p[k + 1] for p in self.ids for k in range(len(p) - 1) if p[k].isalpha()} for b in range(128)] + [False] * 128)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.max_pairs = max_pairs
        self.end = self.lib.eos_id()
        self.cache = SegmentCache(self.encode_many)

    def merge(self, text: str) -> list[str]:
        """BPE by definition: the best-scored adjacent pair first, the leftmost of equal ones. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.scores.get(parts[k] + parts[k + 1], -np.inf), -k))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def stands(self, p: str) -> bool:
        if (known := self.whole.get(p)) is None:
            known = self.whole[p] = self.merge(p) == [p]
        return known

    def encode_segment(self, s: str) -> list[str]:
        """Pieces of a text of known characters only."""
        greedy = [p for _, p in self.auto.iter_long(s)]
        if all(map(self.stands, greedy)) and all(map(self.compatible, greedy, greedy[1:])):
            return greedy  # the longest matches need no correction
        n = len(s)
        here: list[list[str]] = [[] for _ in range(n)]
        for end, p in self.auto.iter(s):
            here[end - len(p) + 1].append(p)
        for c in here:
            c.sort(key=len)
        out: list[str] = []
        left = [len(c) for c in here]  # how many of a position's matches are still untried
        failed, at = 0, 0
        while at < n:
            took = False
            while left[at]:
                left[at] -= 1
                p = here[at][left[at]]
                if not failed >> (at + len(p)) & 1 and self.stands(p) and (not out or self.compatible(out[-1], p)):
                    out.append(p)
                    at += len(p)
                    took = True
                    if at < n:
                        left[at] = len(here[at])
                    break
            if not took:
                failed |= 1 << at
                if not out:
                    raise ValueError(f"no encoding: {s!r}")
                at -= len(out.pop())
        return out

    def encode_many(self, segments: list[bytes]) -> list[list[int]]:
        return [self._ids(x.decode("utf-8").replace(" ", MARK)) for x in segments]

    def _ids(self, s: str) -> list[int]:
        ids, known = self.ids, self.ids
        if all(c in known for c in s):
            return [ids[p] for p in self.encode_segment(s)]
        out, run = [], ""
        for c in s:
            if c in known:
                run += c
                continue
            if run:
                out += [ids[p] for p in self.encode_segment(run)]
                run = ""
            out += [self.bytes[b] for b in c.encode()]
        return out + ([ids[p] for p in self.encode_segment(run)] if run else [])

    def segments(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut before each run of spaces, around newlines, and between a letter and punctuation no piece joins to it."""
        if not len(buf):
            return (np.zeros(0, np.int64),) * 3
        space, line, cls = buf == 32, buf == 10, classes(buf)
        cut = line.copy()
        cut[1:] |= line[:-1]
        cut[0] = True
        cut[1:] |= (space[1:] & ~space[:-1]) | ((cls[:-1] == LETTER) & (cls[1:] == PUNCT) & self.apart[buf[1:]])
        return cuts_to_segments(cut, offs)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: all ids with the end id of each text, and the ids of each text."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        for i, j, buf, offs in pieces(*texts(column)):
            starts, ends, doc = self.segments(buf, offs)
            flat, lens = self.cache.get(buf, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            n = np.bincount(doc, lens, j - i).astype(np.int64) if len(doc) else np.zeros(j - i, np.int64)
            out = np.full(len(flat) + j - i, self.end, np.int32)
            stops = np.cumsum(n + 1) - 1
            put = np.ones(len(out), bool)
            put[stops] = False
            out[put] = flat
            yield out, n + 1

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def encode_table(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int with the end id), decoded for each row; no shuffle. Null text counts as empty (only the
    end id, decoded to the empty text); repeated rows are encoded each; other columns are ignored; an empty table
    gives none; texts of any length are encoded whole."""
    tune(docs.sparkSession)

    def run(batches):
        codec = kept(("piece-codec", model), lambda: PieceCodec(model))
        for b in batches:
            k0 = 0
            for out, n in codec.encode(b.column(1)):
                ends = np.cumsum(n)
                decoded = [codec.decode(out[e - c : e].tolist()) for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                ids = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), out)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k0, len(n)), ids, pa.array(decoded, pa.string())], [key, "ids", "decoded"])
                k0 += len(n)

    d = docs.select(key, text)
    return d.mapInArrow(tidy(run), f"{key} {dict(d.dtypes)[key]}, ids array<int>, decoded string")


def digest_table(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of encode_table's rows, taken in the same Python pass so
    that ids and texts need not be written or sent back."""
    tune(docs.sparkSession)

    def run(batches):
        codec = kept(("piece-codec", model), lambda: PieceCodec(model))
        names = kept(("id-names", model), lambda: [str(i) for i in range(codec.lib.get_piece_size())])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            a, c, n_all = [], [], []
            for out, n in codec.encode(b.column(1)):
                n_all.append(n)
                for e, m in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
                    ids = out[e - m : e].tolist()
                    a.append(sha(" ".join(map(names.__getitem__, ids))))
                    c.append(sha(codec.decode(ids)))
            n_all = np.concatenate(n_all) if n_all else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_all, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(key, text)
    return d.mapInArrow(tidy(run), f"{key} {dict(d.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
