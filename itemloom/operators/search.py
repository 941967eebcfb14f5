"""What a text search is made of: query terms, searchable documents, postings, vocabulary, windows.

The postings hold surface tokens.  Stems and prefixes are resolved against the distinct
vocabulary, so a query term expands to surface tokens and always meets the postings in
one equi-join; running text is never stemmed row by row.  ``search_index`` stores postings
and searches them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import text as tx
from itemloom.functions.stemming import stem

# ---- fixed values: field weights, BM25 constants, snippet length ----
FIELD_WEIGHTS = {"prompt": 10.0, "options": 3.0, "explanation": 1.0}
K1, B = 1.2, 0.75
SNIPPET_TOKENS = 14
ELLIPSIS = "…"


# ----------------------------------------------------------------- queries


def has_terms(raw: str) -> bool:
    """Whether a search string has anything to match on."""
    return any(ch.isalnum() or ch == "_" for ch in raw or "")


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, raw) -> (query_id, term_no, kind, term, is_prefix); all terms required.

    Quoted runs (the last may be unterminated) are phrases; other words are literal,
    a trailing ``*`` asks for a prefix, and words without a word character drop out.
    """
    pieces = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(r'"[^"]*"?|[^\s"]+'), F.lit(0))

    def read(piece: Column) -> Column:
        quoted = piece.startswith('"')
        phrase = F.btrim(F.replace(piece, F.lit('"'), F.lit("")))
        return F.struct(
            F.when(quoted, "phrase").otherwise("word").alias("kind"),
            F.when(quoted, phrase).otherwise(F.rtrim(piece, F.lit("*"))).alias("term"),
            (~quoted & piece.endswith("*")).alias("is_prefix"),
        )

    terms = F.filter(F.transform(pieces, read), lambda t: t["term"].rlike(r"(?U)\w"))
    return queries.select("query_id", F.posexplode(terms).alias("term_no", "t")).select("query_id", "term_no", "t.*")


def query_tokens(terms: DataFrame) -> DataFrame:
    """Terms as token runs: (query_id, term_no, n_terms, offset, n_tokens, token, is_prefix)."""
    per_query = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    tokens = tx.search_tokens(F.col("term"))
    return (
        terms.join(per_query, "query_id")
        .select("query_id", "term_no", "n_terms", "is_prefix", tokens.alias("ts"))
        .select("query_id", "term_no", "n_terms", "is_prefix", F.size("ts").alias("n_tokens"), F.posexplode("ts").alias("offset", "token"))
        .withColumn("is_prefix", F.col("is_prefix") & (F.col("offset") == F.col("n_tokens") - 1))
    )


# --------------------------------------------------------------- documents


def search_documents(records: DataFrame) -> DataFrame:
    """Nested records -> one row of searchable fields each; no shuffle."""
    explained = F.array_compact(F.transform("options", lambda o: o["explanation_md"]))
    body = F.concat(F.coalesce("overall_explanation_md", F.lit("")), F.lit("\n"), F.array_join(explained, "\n"))
    return records.select(
        F.col("id").alias("doc_id"),
        F.coalesce("prompt_md", F.lit("")).alias("prompt"),
        F.array_join(F.transform("options", lambda o: F.coalesce(o["text_md"], F.lit(""))), "\n").alias("options"),
        F.btrim(body, F.lit("\n ")).alias("explanation"),
    )


def search_documents_from_tables(question: DataFrame, option: DataFrame) -> DataFrame:
    """The same rows from the question and option tables."""
    parts = option.groupBy(F.col("question_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "text_md", "explanation_md"))).alias("options")
    )
    empty = F.array().cast("array<struct<position:int,text_md:string,explanation_md:string>>")
    joined = question.join(parts, "id", "left").withColumn("options", F.coalesce("options", empty))
    return search_documents(joined)


def postings(documents: DataFrame, fields: Sequence[str] = tuple(FIELD_WEIGHTS)) -> DataFrame:
    """(doc_id, doc_len, field, pos, token): a narrow expansion of each document."""
    split = documents.select("doc_id", *[tx.search_tokens(F.col(f)).alias(f) for f in fields])
    sized = split.select("doc_id", F.array(*[F.size(f) for f in fields]).alias("sizes"), F.concat(*fields).alias("all"))
    flat = sized.select("doc_id", F.size("all").alias("doc_len"), "sizes", F.posexplode("all").alias("at", "token"))
    # Position in the concatenation tells the field and the position inside it.
    bases, total = [], F.lit(0)
    for i in range(len(fields)):
        bases.append(total)
        total = total + F.col("sizes")[i]
    field, pos = F.lit(fields[-1]), F.col("at") - bases[-1]
    for i in range(len(fields) - 2, -1, -1):
        inside = F.col("at") < bases[i + 1]
        field = F.when(inside, F.lit(fields[i])).otherwise(field)
        pos = F.when(inside, F.col("at") - bases[i]).otherwise(pos)
    return flat.select("doc_id", "doc_len", field.alias("field"), pos.alias("pos"), "token")


def reindex(posted: DataFrame, documents: DataFrame, affected: DataFrame) -> DataFrame:
    """Replace the postings of affected documents; vanished ones leave no orphan."""
    ids = affected.select(F.col("question_id").alias("doc_id"))
    kept = posted.join(ids, "doc_id", "left_anti")
    fresh = postings(documents.join(ids, "doc_id", "left_semi"))
    return kept.unionByName(fresh)


def vocabulary(posted: DataFrame, stemmed: bool = False) -> DataFrame:
    """Distinct tokens with the form terms are compared on."""
    words = posted.select("token").distinct()
    return words.withColumn("form", stem(F.col("token")) if stemmed else F.col("token"))


def expand_tokens(tokens: DataFrame, words: DataFrame, stemmed: bool = False) -> DataFrame:
    """Query tokens -> the surface tokens they match.

    Prefixes meet the vocabulary through an equi-join: every form offers its leading
    substrings of the lengths some prefix has, so no pair is tested that cannot match.
    """
    asked = tokens.withColumn("form", stem(F.col("token")) if stemmed else F.col("token")).drop("token")
    whole = asked.where(~F.col("is_prefix"))
    exact = (
        whole.join(words, "form")
        if stemmed
        else whole.withColumn("token", F.col("form"))
    )
    starts = asked.where(F.col("is_prefix"))
    lengths = starts.agg(F.collect_set(F.length("form"))).scalar()
    leads = (
        words.select("token", F.col("form").alias("whole"), F.explode(lengths).alias("k"))
        .where(F.length("whole") >= F.col("k"))
        .select("token", F.left("whole", F.col("k")).alias("form"))
    )
    prefixed = starts.join(leads, "form")
    columns = [*[c for c in tokens.columns if c not in ("token", "is_prefix")], "token"]
    return exact.select(*columns).unionByName(prefixed.select(*columns))


# ---------------------------------------------------------------- hits


def top_hits(scored: DataFrame, k: int = 20) -> DataFrame:
    """Best k per query; the literal bound trims each task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy("score", "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- snippets


def best_windows(found: DataFrame, size: int = SNIPPET_TOKENS) -> DataFrame:
    """Per (query, document): the window with most terms, then hits, then earliest field and start."""
    order = F.create_map(*[x for i, f in enumerate(FIELD_WEIGHTS) for x in (F.lit(f), F.lit(i))])
    w = Window.partitionBy("query_id", "doc_id", "field").orderBy("start").rangeBetween(0, size - 1)
    seen = found.select(
        "query_id",
        "doc_id",
        "field",
        "start",
        F.size(F.collect_set("term_no").over(w)).alias("terms"),
        F.count(F.lit(1)).over(w).alias("hits"),
        F.collect_set(F.struct("start", "n_tokens")).over(w).alias("spans"),
    )
    rank = F.struct("terms", "hits", (-order[F.col("field")]).alias("f"), (-F.col("start")).alias("s"))
    return (
        seen.groupBy("query_id", "doc_id")
        .agg(F.max_by(F.struct("field", "start", "spans"), rank).alias("b"))
        .select("query_id", "doc_id", "b.*")
    )


def marked(cut: DataFrame) -> DataFrame:
    """Words of a window and what stands before each -> ``parts array<struct<text, matched>>``.

    ``cut`` has query_id, doc_id, field, start, last, n (tokens of the field), spans, words and before.
    """

    def covered(i: Column) -> Column:
        return F.exists("spans", lambda s: (s["start"] <= i) & (i < s["start"] + s["n_tokens"]))

    def bridged(i: Column) -> Column:
        return F.exists("spans", lambda s: (s["start"] < i) & (i < s["start"] + s["n_tokens"]))

    def pieces(i: Column) -> Column:
        k = i - F.col("start")
        return F.array(
            F.struct(F.get("before", k).alias("text"), bridged(i).alias("matched")),
            F.struct(F.get("words", k).alias("text"), covered(i).alias("matched")),
        )

    dots = lambda test: F.struct(F.when(test, ELLIPSIS).otherwise("").alias("text"), F.lit(False).alias("matched"))
    raw = F.concat(
        F.array(dots(F.col("start") > 0)),
        F.flatten(F.transform(F.sequence("start", "last"), pieces)),
        F.array(dots(F.col("last") < F.col("n") - 1)),
    )
    kind = "array<struct<text:string,matched:boolean>>"

    def merge(done: Column, part: Column) -> Column:
        tail = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(F.concat(tail["text"], part["text"]).alias("text"), part["matched"].alias("matched"))),
        )
        same = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))["matched"] == part["matched"], F.lit(False))
        return F.when(part["text"] == "", done).when(same, grown).otherwise(F.concat(done, F.array(part))).cast(kind)

    merged = F.aggregate(raw.cast(kind), F.array().cast(kind), merge)
    return cut.select("query_id", "doc_id", "field", merged.alias("parts"))


def snippet_text(parts: Column, opening: str = "[", closing: str = "]") -> Column:
    return F.array_join(
        F.transform(
            parts, lambda p: F.when(p["matched"], F.concat(F.lit(opening), p["text"], F.lit(closing))).otherwise(p["text"])
        ),
        "",
    )
