"""Table-generating text operators: each text's rows come from an Arrow-batched Python pass without any shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import passages as P


def _each(docs: DataFrame, make, schema: str, key: str = "doc_id", text: str = "doc") -> DataFrame:
    """Rows of make(key, text) for each row, as tuples in the order of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            rows = [r for k, t in zip(f[key], f[text], strict=True) for r in make(k, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return docs.select(key, text).mapInPandas(run, schema)


def chunk_documents(docs: DataFrame, size: int = P.SIZE, overlap: int = P.OVERLAP, reach: int = P.REACH) -> DataFrame:
    """doc_id, seq, pos, text."""
    return _each(docs, lambda k, t: [(k, i, p, c) for i, (p, c) in enumerate(P.chunks(t, size, overlap, reach))], "doc_id long, seq int, pos int, text string")


def chunk_code(docs: DataFrame, size: int = P.SIZE, overlap: int = 0, reach: int = P.REACH) -> DataFrame:
    """path, seq, pos, text of files (path, doc): breaks before declarations where the path's extension is one of code."""
    return _each(docs, lambda k, t: [(k, i, p, c) for i, (p, c) in enumerate(P.chunks(t, size, overlap, reach, k))], "path string, seq int, pos int, text string", "path")


def chunk_by_tokens(docs: DataFrame, most: int = 900, count=None) -> DataFrame:
    """doc_id, seq, pos, tokens, text; tokens by count(text), words and punctuation unless given."""
    import re

    count = count or (lambda t: len(re.findall(r"\w+|[^\w\s]", t)))
    return _each(docs, lambda k, t: [(k, i, p, count(c), c) for i, (p, c) in enumerate(P.token_chunks(t, count, most))], "doc_id long, seq int, pos int, tokens int, text string")


def snippets(docs: DataFrame, query: list[str], intent: list[str] = (), most: int = 500) -> DataFrame:
    """doc_id, line, snippet."""
    return _each(docs, lambda k, t: [(k, *P.snippet(t, query, intent, most))], "doc_id long, line int, snippet string")


def section_index(docs: DataFrame) -> DataFrame:
    """doc_id, idx, level, title, start, chars, kind, priority, body."""
    return _each(docs, lambda k, t: [(k, s["idx"], s["level"], s["title"], s["start"], len(s["body"]), s["kind"], s["priority"], s["body"]) for s in P.sections(t)], "doc_id long, idx int, level int, title string, start int, chars int, kind string, priority string, body string")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, value."""
    return _each(docs, lambda k, t: [(k, a, b, kind, v) for a, b, kind, _, v in P.find_personal(t)], "doc_id long, start int, end int, kind string, value string")


def redact(docs: DataFrame, mode: str = "mask") -> DataFrame:
    """doc_id, n_found, doc: masked, or with the sentences around the spans taken out (hide)."""

    def make(k, t):
        spans = P.find_personal(t)
        return [(k, len(spans), (P.mask if mode == "mask" else P.hide)(t, spans))]

    return _each(docs, make, "doc_id long, n_found int, doc string")


def gate(docs: DataFrame, guard: bool = True, allowed: bool = False) -> DataFrame:
    """doc_id, n_found, outcome, doc: without guard everything passes; texts with personal data are redacted where that is
    allowed, else they are blocked (and come out without text)."""
    if not guard:
        return docs.select("doc_id", F.lit(0).alias("n_found"), F.lit("pass").alias("outcome"), "doc")
    r = redact(docs)
    found = F.col("n_found") > 0
    return r.select("doc_id", "n_found", F.when(~found, "pass").when(F.lit(allowed), "redacted").otherwise("blocked").alias("outcome"), F.when(~found | F.lit(allowed), F.col("doc")).alias("doc"))
