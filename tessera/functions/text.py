"""Scalar text functions and extractors; the few that depend on order or offsets are Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.containment import clusters_of

LABEL = r"^[A-Z][A-Za-z ]{0,40}:\s*"
CUT = "\x1e"


def norm(c: Column | str) -> Column:
    """Strip white space, lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def title_case(c: Column | str) -> Column:
    """Upper case after anything but a letter, as for names with hyphens and apostrophes."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def insider_name(c: Column | str) -> Column:
    """A name without commas, in title case."""
    return title_case(F.translate(c, ",", ""))


def _limited(parts: Column, shortest: int, longest: int) -> Column:
    """Drop short parts, cut long ones back to a blank and close them with a full stop."""
    cleaned = F.transform(parts, lambda s: F.regexp_replace(F.trim(s), LABEL, ""))
    cut = lambda s: F.concat(F.regexp_replace(F.substring(s, 1, longest), r" [^ ]*$", ""), F.lit("."))
    return F.transform(F.filter(cleaned, lambda s: F.length(s) >= shortest), lambda s: F.when(F.length(s) > longest, cut(s)).otherwise(s))


def sentences(text: Column | str, shortest: int = 20, longest: int = 300) -> Column:
    """Segments between sentence marks."""
    return _limited(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + CUT), CUT), shortest, longest)


def paragraphs(text: Column | str, shortest: int = 100, longest: int = 600) -> Column:
    """Segments between blank lines, white space collapsed."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\n\s*\n", CUT), CUT), lambda p: F.regexp_replace(p, r"\s+", " "))
    return _limited(parts, shortest, longest)


def questions_answers(text: Column | str, shortest: int = 20, longest: int = 600) -> Column:
    """Segments between speaker marks such as Q: or Answer-; a long one becomes its sentences."""
    parts = F.split(F.regexp_replace(text, r"(?i)(question|answer|operator|q|a)[:\-]\s*", CUT), CUT)
    plain = F.filter(F.transform(parts, lambda s: F.regexp_replace(F.trim(s), LABEL, "")), lambda s: F.length(s) >= shortest)
    return F.flatten(F.transform(plain, lambda s: F.when(F.length(s) > longest, sentences(s, shortest)).otherwise(F.array(s))))


def whole(text: Column | str, shortest: int = 50, longest: int = 512) -> Column:
    """The text as one segment, white space collapsed, a long one cut back to a blank and closed with a full stop; none if it is short."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, longest), r" [^ ]*$", ""), F.lit("."))
    return F.filter(F.array(F.when(F.length(plain) > longest, cut).otherwise(plain)), lambda s: F.length(s) >= shortest)


STRATEGIES = {"sentences": sentences, "paragraphs": paragraphs, "qna": questions_answers, "full": whole}


def segments(transcripts: DataFrame, strategy: str = "sentences", shortest: int = 50, longest: int = 512) -> DataFrame:
    """(symbol, quarter, year, date, pos, segment) of transcripts with a content; what isn't told of them is UNKNOWN or a question mark."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    told = {"symbol": "UNKNOWN", "quarter": "?", "year": "?", "date": "?"}
    known = [F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(c) if c in transcripts.columns else F.lit(v).alias(c) for c, v in told.items()]
    rows = transcripts.filter("content is not null and content != ''")
    return rows.select(*known, F.posexplode(STRATEGIES[strategy]("content", shortest, longest)).alias("pos", "segment"))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def number_shapes(text: Column | str, vocabulary: Sequence[str]) -> Column:
    """Tokens that are numbers become their shape if it is known, else [NUM]."""
    shape = lambda t: F.concat(F.lit("["), F.regexp_replace(t, r"[0-9]", "X"), F.lit("]"))
    known = F.array(*[F.lit(v) for v in vocabulary])
    one = lambda t: F.when(t.rlike(r"^[0-9]+([.,][0-9]+)*$"), F.when(F.array_contains(known, shape(t)), shape(t)).otherwise(F.lit("[NUM]"))).otherwise(t)
    return F.array_join(F.transform(F.split(text, " "), one), " ")


def strip_think(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def strip_fences(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)```(?:json|sql|cypher)?\s*|```", ""))


def redact(secret: Column | str, shown: int = 4) -> Column:
    """All but the last characters masked."""
    n = F.greatest(F.lit(0), F.length(secret) - shown)
    return F.concat(F.repeat(F.lit("*"), n), F.substr(F.col(secret) if isinstance(secret, str) else secret, n + 1))


def phrases(text: Column | str, head: str, words: int = 4) -> Column:
    """Distinct phrases `head` followed by up to so many words, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{head}((?: [\p{{L}}]+){{1,{words}}})"), F.lit(1)))


def lexicon_hits(docs: DataFrame, lexicon: Sequence[str], text: str = "text") -> DataFrame:
    """One row for each known name that a text contains, whatever the case."""
    hits = F.filter(F.array(*[F.lit(x) for x in lexicon]), lambda x: F.contains(F.lower(F.col(text)), F.lower(x)))
    return docs.withColumn("term", F.explode(hits))


def first_pattern(text: Column | str, patterns: Sequence[tuple[str, str]]) -> Column:
    """Name of the first pattern, in their order, that the lower-case text has."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def section_key(section: Column | str) -> tuple[Column, Column]:
    """Number and letter of a section id; 999 without a number."""
    number = F.regexp_extract(section, r"^([0-9]+)", 1)
    return F.when(number == "", F.lit(999)).otherwise(number.cast("int")), F.regexp_extract(section, r"([A-Z]*)$", 1)


def object_path(prefix: Column, name: Column | str, day: Column, key: Column) -> Column:
    """prefix/year/name_yyyymmdd_hash.json, the hash being eight hex digits of the key's MD5."""
    stem = F.concat_ws("_", F.col(name) if isinstance(name, str) else name, F.date_format(day, "yyyyMMdd"), F.substring(F.md5(key), 1, 8))
    return F.concat(F.concat_ws("/", prefix, F.date_format(day, "yyyy"), stem), F.lit(".json"))


def content_key(content: Column | str) -> Column:
    """The first 16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")), 256), 1, 16)


def trading_week(day: Column | str) -> tuple[Column, Column]:
    """Monday, and Friday or the day itself if earlier."""
    monday = F.date_trunc("week", day).cast("date")
    return monday, F.least(F.to_date(day), F.date_add(monday, 4))


# --- order- and offset-dependent functions --------------------------------------------------------------


def _chunk_end(text: str, start: int, size: int) -> int:
    """Where the chunk from start ends: at the text's end, else at the last break of its second half.

    A blank line is preferred; the chunk then stops before it. A full stop stays with its blank in the chunk.
    """
    limit = start + size
    if limit >= len(text):
        return len(text)
    breaks = (("\n\n", 0, 100), (". ", 2, 50))  # mark, characters of it that stay, least length of the chunk
    found = ((text.rfind(mark, start + size // 2, limit), kept, least) for mark, kept, least in breaks)
    return next((at + kept for at, kept, least in found if at - start > least), limit)


def _chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    start, end = 0, 0
    while end < len(text):
        end = _chunk_end(text, start, size)
        yield start, end
        start = max(end - overlap, start + 1)


def spans_of(text: str | None, size: int = 12_000, overlap: int = 800) -> list[dict]:
    """Overlapping chunks of a text; sizes below 2000 count as that, overlaps above half a size as that half."""
    size = max(size, 2000)
    return [{"start": a, "end": b} for a, b in _chunks(text or "", size, min(max(overlap, 0), size // 2))]


_SPAN = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]


@F.pandas_udf(T.ArrayType(T.StructType(_SPAN)))
def chunk_spans(text: pd.Series) -> pd.Series:
    return text.map(spans_of)


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def best_match(name: str, known: Sequence[str], threshold: float = 0.85) -> str | None:
    """The first known name that equals the given one, else the likest above the threshold, of a tie the first."""
    fold = lambda x: x.strip().lower()
    wanted, plain = fold(name), [fold(x) for x in known]
    if wanted in plain:
        return known[plain.index(wanted)]
    likeness = [0.95 if x in wanted or wanted in x else ratio(wanted, x) for x in plain]
    top = max(likeness, default=0.0)
    return known[likeness.index(top)] if top > threshold else None


@F.pandas_udf(T.StringType())
def resolve_name(name: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([best_match(n, list(k)) if n else None for n, k in zip(name, known, strict=True)])


_SPEAKER = re.compile(r"^([A-Z][A-Za-z .\-]*?):[ \t]*(.*(?:\n(?![A-Z][A-Za-z .\-]*?:).*)*)", re.M)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), *_SPAN])))
def speaker_segments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"speaker": m[1].strip(), "text": m[2].strip(), "start": m.start(), "end": m.end()} for m in _SPEAKER.finditer(t or "")])


class _Plain(HTMLParser):
    """Texts of block elements without scripts, styles and page furniture."""

    SKIP = frozenset("script style nav header footer aside noscript head".split())
    #: What can't stand in menus and the like, so it ends one that was never closed.
    MAIN = frozenset("body main article".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.skipped = [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.MAIN:
            self.open.clear()
        if tag in self.SKIP:
            self.open.append((tag, len(self.skipped)))
        if tag in ("p", "div", "h1", "h2", "h3", "li", "br"):
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.skipped[self.open[k][1] :], self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        (self.skipped if self.open else self.parts).append(data)

    def close(self) -> None:
        """An element that is open at the end hides nothing but scripts and styles, as nobody closed it."""
        super().close()
        if self.open and self.open[0][0] not in ("script", "style", "head"):
            self.parts += self.skipped[self.open[0][1] :]


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    def one(source: str | None) -> str:
        parser = _Plain()
        parser.feed(source or "")
        parser.close()
        return re.sub(r"\n\s*\n+", "\n\n", "".join(parser.parts)).strip()

    return html.map(one)


def cluster_entities(mentions: DataFrame, group: str, label: str, name: str, order: str) -> DataFrame:
    """(group, label, cluster, canonical_name, variants, mention_count) of mentions clustered within each group and label.

    Mentions are first reduced to distinct names with their first place and number, by partial sums, so the
    clustering task of a group and label holds its vocabulary and not its mentions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "n"])
        rows["cluster"] = clusters_of(rows["n"].tolist())
        out = rows.groupby("cluster").agg(canonical_name=("n", lambda s: max(s, key=len)), variants=("n", lambda s: "|".join(sorted(set(s)))), mention_count=("c", "sum")).reset_index()
        out.insert(0, "l", rows["l"].iloc[0])
        out.insert(0, "g", rows["g"].iloc[0])
        return out

    held = mentions.select(F.col(group).alias("g"), F.col(label).alias("l"), F.col(name).alias("n"), F.col(order).alias("o")).filter("n is not null")
    distinct = held.groupBy("g", "l", "n").agg(F.min("o").alias("o"), F.count("*").alias("c"))
    schema = f"g {kinds[group]}, l {kinds[label]}, cluster int, canonical_name string, variants string, mention_count long"
    return distinct.groupBy("g", "l").applyInPandas(run, schema).withColumnsRenamed({"g": group, "l": label})


@F.udtf(returnType="speaker string, text string, start int, end int")
class SpeakerSegments:
    """A row for each speaker segment of a text: SELECT ... FROM t, LATERAL speaker_segments_of(t.text)."""

    def eval(self, text: str):
        for m in _SPEAKER.finditer(text or ""):
            yield m[1].strip(), m[2].strip(), m.start(), m.end()


@F.udtf(returnType="start int, end int, text string")
class Chunks:
    """A row for each overlapping chunk of a text, LATERAL chunks_of(t.text, size, overlap)."""

    def eval(self, text: str, size: int, overlap: int):
        for span in spans_of(text, size, overlap):
            yield span["start"], span["end"], text[span["start"] : span["end"]]


def register(spark: SparkSession) -> None:
    """SQL names for the functions that SQL has no form of, table functions among them."""
    spark.udtf.register("speaker_segments_of", SpeakerSegments)
    spark.udtf.register("chunks_of", Chunks)
    spark.udf.register("fuzzy_ratio", fuzzy_ratio)
    spark.udf.register("chunk_spans", chunk_spans)
    spark.udf.register("speaker_segments", speaker_segments)
    spark.udf.register("html_text", html_text)
