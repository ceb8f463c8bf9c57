"""SQL table functions over texts: `SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 900) c`.

Options are constants that are checked when the query is analysed, and some of them choose the columns.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gleanery.functions import passages as P


def _option(name: str, arg: AnalyzeArgument | None, default, least: int):
    """The value of a constant option; null is the default."""
    if arg is None or (arg.isConstantExpression and arg.value is None):
        return default
    if not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    if not isinstance(arg.value, type(default)) or arg.value < least:
        raise ValueError(f"{name} must be {'true or false' if isinstance(default, bool) else f'a number of at least {least}'}")
    return arg.value


def _columns(*names: str) -> StructType:
    out = StructType()
    for n in names:
        out = out.add(n, StringType() if n in ("text", "title", "kind", "priority", "body", "snippet") else IntegerType())
    return out


@udtf
class Chunks:
    """seq, pos and text of a text's chunks; arguments text, size, overlap, with_text (false leaves text out)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None, with_text: AnalyzeArgument = None) -> AnalyzeResult:
        size_, overlap_ = _option("size", size, P.SIZE, 1), _option("overlap", overlap, P.OVERLAP, 0)
        if overlap_ >= size_:
            raise ValueError("overlap must be less than size")
        return AnalyzeResult(_columns("seq", "pos", *(["text"] if _option("with_text", with_text, True, 0) else [])))

    def eval(self, text: str, size: int = None, overlap: int = None, with_text: bool = None):
        size = P.SIZE if size is None else size
        overlap = P.OVERLAP if overlap is None else overlap
        for i, (at, part) in enumerate(P.chunks(text or "", size, overlap, min(P.REACH, size // 4))):
            yield (i, at) if with_text is False else (i, at, part)


@udtf
class Sections:
    """idx, level, title, start, chars, kind, priority and body of a text's sections; arguments text, with_body."""

    @staticmethod
    def analyze(text: AnalyzeArgument, with_body: AnalyzeArgument = None) -> AnalyzeResult:
        body = ["body"] if _option("with_body", with_body, True, 0) else []
        return AnalyzeResult(_columns("idx", "level", "title", "start", "chars", "kind", "priority", *body))

    def eval(self, text: str, with_body: bool = None):
        for s in P.sections(text or ""):
            row = (s["idx"], s["level"], s["title"], s["start"], len(s["body"]), s["kind"], s["priority"])
            yield row if with_body is False else (*row, s["body"])


@udtf
class Snippet:
    """line, snippet of the place with most of the query's words; arguments text, query, most (characters)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, query: AnalyzeArgument, most: AnalyzeArgument = None) -> AnalyzeResult:
        _option("most", most, 500, 4)
        return AnalyzeResult(_columns("line", "snippet"))

    def eval(self, text: str, query: str, most: int = None):
        yield P.snippet(text or "", (query or "").split(), (), 500 if most is None else most)


FUNCTIONS = {"chunks": Chunks, "sections": Sections, "snippet": Snippet}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to spark.sql under their names."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
