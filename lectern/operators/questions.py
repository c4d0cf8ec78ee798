"""Extractive question sets from chunks: candidates, rotation, adversarials, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import bind, first_where, last_of
from lectern.functions.text import (
    count_words,
    native_normalise,
    needs_python_fold,
    normalise,
    normalise_all,
    normalise_hard,
    sentence_units,
    split_lines,
    strip,
)
from lectern.operators.scans import global_offsets
from lectern.session import reliable_checkpoint


def _clauses(text: Column) -> Column:
    """Clauses of a text that are short enough to be a support."""
    parts = F.split(text, rf"{fixed.S}*[;:]{fixed.S}*", -1)
    return F.filter(parts, lambda part: F.length(part) <= fixed.SUPPORT_MAX_CHARS)


def short_support(
    sentence: Column,
    answer: Column | None = None,
    folded_answer: Column | None = None,
    folded_clauses: Column | None = None,
) -> Column:
    """A support of at most 600 characters: whole, a clause with the answer, or a cut.

    Answer and clauses are compared in their comparison form: the given ones, in the order of
    the clauses, or the JVM's where none are given or they are NULL.
    """
    limit = fixed.SUPPORT_MAX_CHARS

    def choose(text):
        def pick(short):
            choices = []
            if answer is not None:
                low = native_normalise(answer)
                lows = F.transform(short, native_normalise)
                if folded_answer is not None:
                    low = F.coalesce(folded_answer, low)
                    lows = F.coalesce(folded_clauses, lows)
                pairs = F.zip_with(short, lows, lambda p, q: F.struct(p.alias("text"), q.alias("low")))
                choices.append(first_where(pairs, lambda pair: pair["low"].contains(low))["text"])
            choices.append(F.get(short, F.lit(0)))
            return strip(F.coalesce(*choices))

        return F.when(F.length(text) <= limit, text).otherwise(
            F.coalesce(
                bind(_clauses(text), pick), F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
            )
        )

    return bind(strip(sentence), choose)


def _candidate(kind: str, question: str, answer: Column, support: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("question_type"),
        F.lit(question).alias("question"),
        answer.alias("answer"),
        support.alias("support"),
    )


def _found(units: Column, test, kind: str, question: str, answer=None) -> Column:
    """Candidate of the first unit that passes, or NULL."""

    def build(unit):
        text = unit["text"]
        return F.when(
            unit.isNotNull(), _candidate(kind, question, answer(text) if answer else text, text)
        )

    return bind(first_where(units, test), build)


def _raw_candidates(units: Column, heading: Column, heading_inside: Column) -> Column:
    short = fixed.ANSWER_MAX_CHARS

    def match(pattern):
        return lambda text: F.regexp_extract(text, pattern, 0)

    def brief(unit):
        return F.length(unit["text"]) <= fixed.SUPPORT_MAX_CHARS

    def deadline(text):
        whole = strip(F.regexp_extract(text, f"{fixed.DEADLINE}[^,;.]*", 0))
        return F.when(F.length(whole) > short, match(fixed.DEADLINE)(text)).otherwise(whole)

    def legal(text):
        return F.regexp_replace(match(fixed.LEGAL_REFERENCE)(text), "^[ ,;:.]+|[ ,;:.]+$", "")

    def quantity_found(unit):
        found = match(fixed.QUANTITY)(unit["text"])
        return (found != "") & ~found.rlike(fixed.BARE_YEAR)

    def plain(unit):
        return ~(
            unit["text"].startswith(fixed.CHAPTER_TITLE_PREFIX)
            | unit["text"].startswith(fixed.ANNEX_TITLE_PREFIX)
        )

    def fallback(unit):
        return bind(
            short_support(unit["text"]),
            lambda s: _candidate(fixed.TYPE_DEFINITION, fixed.QUESTION_FALLBACK, s, s),
        )

    return F.array_compact(
        F.array(
            F.when(
                heading_inside,
                _candidate(fixed.TYPE_STRUCTURE, fixed.QUESTION_STRUCTURE, heading, heading),
            ),
            _found(
                units,
                lambda u: u["folded"].rlike(fixed.DEFINITION_VERBS) & brief(u),
                fixed.TYPE_DEFINITION,
                fixed.QUESTION_DEFINITION,
            ),
            _found(
                units,
                lambda u: u["text"].rlike(fixed.LEGAL_REFERENCE),
                fixed.TYPE_LEGAL,
                fixed.QUESTION_LEGAL,
                legal,
            ),
            _found(
                units,
                quantity_found,
                fixed.TYPE_QUANTITY,
                fixed.QUESTION_QUANTITY,
                match(fixed.QUANTITY),
            ),
            _found(
                units,
                lambda u: u["text"].rlike(fixed.DEADLINE),
                fixed.TYPE_DEADLINE,
                fixed.QUESTION_DEADLINE,
                deadline,
            ),
            _found(
                units,
                lambda u: u["text"].rlike(fixed.ENUMERATOR) & u["folded"].rlike(fixed.ACTION_VERBS),
                fixed.TYPE_PROCEDURE,
                fixed.QUESTION_PROCEDURE,
            ),
            _found(
                units,
                lambda u: u["text"].rlike(fixed.ACTORS)
                & u["folded"].rlike(fixed.ROLE_VERBS)
                & brief(u),
                fixed.TYPE_ROLE,
                fixed.QUESTION_ROLE,
            ),
            F.when(
                F.size(units) > 0,
                bind(F.coalesce(first_where(units, plain), F.get(units, F.lit(0))), fallback),
            ),
        )
    )


def extract_candidates(chunks: DataFrame, text: str = "text", path: str = "section_path") -> DataFrame:
    """Adds ``candidates``: at most one per rule, in rule order, all found in the text.

    ``path`` may be NULL or empty; the first line then serves as the heading.
    """
    heading = F.coalesce(
        last_of(F.col(path)), strip(F.coalesce(F.get(split_lines(F.col(text)), F.lit(0)), F.lit("")))
    )
    prepared = chunks.withColumn("__heading", heading)
    prepared = prepared.withColumn("__hard", needs_python_fold(F.concat(text, "__heading")))
    prepared = prepared.withColumn("__pieces", sentence_units(F.col(text)))
    # One array holds everything that must be folded: text, heading, then the units.
    everything = F.concat(F.array(text, "__heading"), F.col("__pieces"))
    prepared = prepared.withColumn("__all", normalise_all(everything, F.col("__hard")))

    def raw(folded):
        units = F.zip_with(
            F.col("__pieces"),
            F.slice(folded, 3, F.size(folded)),
            lambda unit, low: F.struct(unit.alias("text"), low.alias("folded")),
        )
        inside = (F.col("__heading") != "") & folded[0].contains(folded[1])
        return F.struct(
            folded[0].alias("text"),
            bind(units, lambda u: _raw_candidates(u, F.col("__heading"), inside)).alias("raw"),
        )

    def to_fold(c):
        """Answer, support and, of a long support, its clauses."""
        support = strip(c["support"])
        none = F.array().cast("array<string>")
        clauses = F.when(F.length(support) > fixed.SUPPORT_MAX_CHARS, _clauses(support)).otherwise(none)
        return F.concat(F.array(c["answer"], c["support"]), clauses)

    def finish(env):
        def entry(c, folds):
            return F.struct(
                c.alias("c"),
                folds.alias("folds"),
                F.struct(
                    c["question_type"],
                    c["question"],
                    F.coalesce(F.get(folds, F.lit(0)), native_normalise(c["answer"])).alias("answer"),
                    F.coalesce(F.get(folds, F.lit(1)), native_normalise(c["support"])).alias("support"),
                ).alias("key"),
            )

        entries = F.zip_with(env["raw"], env["folds"], entry)

        def distinct(all_entries):
            def keep(e, i):
                grounded = env["text"].contains(e["key"]["answer"])
                earlier = F.exists(F.slice(all_entries, 1, i), lambda p: p["key"] == e["key"])
                return (e["c"]["answer"] != "") & grounded & ~earlier

            return F.transform(
                F.filter(all_entries, keep),
                lambda e: F.struct(
                    e["c"]["question_type"].alias("question_type"),
                    e["c"]["question"].alias("question"),
                    e["c"]["answer"].alias("answer"),
                    short_support(
                        e["c"]["support"],
                        e["c"]["answer"],
                        F.when(e["folds"].isNotNull(), e["key"]["answer"]),
                        F.slice(e["folds"], 3, F.greatest(F.size(e["folds"]) - 2, F.lit(0))),
                    ).alias("support"),
                ),
            )

        return bind(entries, distinct)

    # Rows that need Python have what the rules found folded there as well.
    prepared = prepared.withColumn("__raw", bind(F.col("__all"), raw))
    found = F.col("__raw.raw")
    prepared = prepared.withColumn("__folds", normalise_hard(F.transform(found, to_fold), F.col("__hard")))
    unfolded = F.transform(found, lambda c: F.lit(None).cast("array<string>"))
    env = F.struct(
        F.col("__raw.text").alias("text"), found.alias("raw"), F.coalesce("__folds", unfolded).alias("folds")
    )
    candidates = bind(env, finish)
    return prepared.select(*chunks.columns, candidates.alias("candidates"))


def select_candidates(candidates: Column, index: Column) -> Column:
    """The one or two candidates a chunk contributes, by its position in the document.

    Rotates through the candidates; a second one is added on every fourth chunk, unless it
    would repeat the first one's question.
    """

    def rotate(c):
        n = F.size(c)
        primary = F.when(
            (n > 1) & (index % 3 != 0), F.get(c, (F.lit(1) + index % (n - 1)).cast("int"))
        ).otherwise(F.get(c, F.lit(0)))
        extra = F.when(
            (n > 2) & (index % 4 == 0), F.get(c, (F.lit(2) + index % (n - 2)).cast("int"))
        )
        return bind(
            F.array_compact(F.array(primary, extra)),
            lambda chosen: F.filter(
                chosen, lambda x, i: (i == 0) | (x["question"] != F.get(chosen, F.lit(0))["question"])
            ),
        )

    return bind(candidates, rotate)


def difficulty(question_type: Column, size: Column) -> Column:
    """easy, medium or hard, from the kind of question and the length of the chunk.

    ``size`` is the chunk's token count, or its word count where that is missing or zero.
    """
    hard = question_type.isin(fixed.TYPE_LEGAL, fixed.TYPE_DEADLINE, fixed.TYPE_PROCEDURE)
    medium = question_type.isin(fixed.TYPE_QUANTITY, fixed.TYPE_ROLE)
    return (
        F.when(hard | (size > 700), "hard").when(medium | (size > 350), "medium").otherwise("easy")
    )


def source_year(document_id: Column) -> Column:
    return F.element_at(F.split(document_id, "-"), -1).cast("int")


def adversarial_count(n_items: int) -> int:
    """About one in twenty, at least one; ties round to even."""
    return max(1, round(n_items * fixed.ADVERSARIAL_SHARE))


def adversarial_questions(spark, n_questions: int, n_chunks: int) -> DataFrame:
    """``j, chunk_at, question`` of the adversarial items, from arithmetic on ``j`` alone.

    A question met again on the same chunk gets its number appended.
    """
    templates = F.array(*[F.lit(q) for q in fixed.ADVERSARIAL_QUESTIONS])
    drawn = spark.range(n_questions).select(
        F.col("id").alias("j"),
        ((F.col("id") * fixed.ADVERSARIAL_STRIDE + fixed.ADVERSARIAL_OFFSET) % n_chunks).alias(
            "chunk_at"
        ),
        F.get(templates, (F.col("id") % len(fixed.ADVERSARIAL_QUESTIONS)).cast("int")).alias("base"),
    )
    seen = F.row_number().over(Window.partitionBy("chunk_at", "base").orderBy("j"))
    numbered = F.concat(
        F.expr("left(base, length(base) - 1)"), F.format_string(" (référence %d) ?", "j")
    )
    return drawn.withColumn("__seen", seen).select(
        "j",
        "chunk_at",
        F.when(F.col("__seen") == 1, F.col("base")).otherwise(numbered).alias("question"),
    )


_CANDIDATE_COLUMNS = ("chunk_id", "document_id", "section_path", "page_start", "page_end")


def chunk_candidates(chunks: DataFrame) -> DataFrame:
    """What the question set needs of each chunk, without its text.

    ``chunks``: ``chunk_id, document_id, text, token_count, section_path, page_start,
    page_end``. The texts are read here, where they are scanned, and go no further.
    """
    size = F.coalesce(F.nullif("token_count", F.lit(0)), count_words(F.col("text")))
    return extract_candidates(chunks).select(*_CANDIDATE_COLUMNS, size.alias("size"), "candidates")


def _first_of_each_question(chosen: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows that share a chunk id keep each question once, in the first row that asks it.

    Only rows of ``repeated`` chunk ids are looked at; all others pass as they are.
    """
    by = Window.partitionBy("chunk_id", "__item.question").orderBy(
        "document_id", "chunk_index", "__slot"
    )
    first = (
        chosen.join(repeated, "chunk_id", "left_semi")
        .select("chunk_id", "document_id", "chunk_index", F.posexplode("__chosen").alias("__slot", "__item"))
        .withColumn("__nth", F.row_number().over(by))
        .filter("__nth = 1")
        .groupBy("chunk_id", "document_id", "chunk_index")
        .agg(F.array_sort(F.collect_list(F.struct("__slot", "__item"))).alias("__kept"))
    )
    keys = ("chunk_id", "document_id", "chunk_index")
    first = first.withColumnsRenamed({k: f"__first_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__first_{k}")) for k in keys]
    marked = chosen.join(
        repeated.select(F.col("chunk_id").alias("__repeated")),
        F.col("chunk_id").eqNullSafe(F.col("__repeated")),
        "left",
    ).join(first, same, "left")
    kept = F.transform("__kept", lambda x: x["__item"])
    none = F.filter("__chosen", lambda _: F.lit(False))
    return marked.select(
        *[c for c in chosen.columns if c != "__chosen"],
        F.when(F.col("__repeated").isNull(), F.col("__chosen"))
        .otherwise(F.coalesce(kept, none))
        .alias("__chosen"),
    )


def build_questions(candidates: DataFrame) -> DataFrame:
    """The whole question set, from :func:`chunk_candidates` with their ``chunk_index``.

    Items are numbered over documents in order of their id, then chunks, then slots;
    adversarial items follow. The chosen items are checkpointed once and read for the
    numbering and for the result; the numbering itself sorts chunk keys and counts only.
    """
    chosen = reliable_checkpoint(
        candidates.select(
            *_CANDIDATE_COLUMNS,
            "chunk_index",
            "size",
            select_candidates(F.col("candidates"), F.col("chunk_index")).alias("__chosen"),
        )
    )
    repeated = chosen.groupBy("chunk_id").count().filter("count > 1").select("chunk_id")
    if not repeated.isEmpty():
        chosen = reliable_checkpoint(_first_of_each_question(chosen, repeated))
    counted = chosen.select(
        "chunk_id", "document_id", "chunk_index", F.size("__chosen").alias("__n")
    )
    # A row is known by its document and position: chunk ids may be repeated.
    numbered = global_offsets(
        counted, ["document_id", "chunk_index"], {"chunk_at": F.lit(1), "__serial": F.col("__n")}
    ).select(
        F.col("document_id").alias("__document"),
        F.col("chunk_index").alias("__index"),
        "chunk_at",
        "__serial",
    )
    totals = counted.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("__n"), F.lit(0)).alias("items")
    ).first()
    n_chunks, n_items = totals["chunks"], totals["items"]
    if n_chunks == 0:
        raise ValueError("no chunks to ask about")
    placed = chosen.join(
        numbered,
        F.col("document_id").eqNullSafe(F.col("__document"))
        & F.col("chunk_index").eqNullSafe(F.col("__index")),
    ).drop("__document", "__index")
    answerable = placed.select(
        "*", F.posexplode("__chosen").alias("__slot", "__item")
    ).select(
        (F.col("__serial") + F.col("__slot") + 1).alias("__number"),
        "__item.question",
        "__item.answer",
        F.lit("extractive").alias("answer_type"),
        "__item.question_type",
        *_chunk_fields(F.col("__item.question_type")),
        F.col("__item.support").alias("supporting_text"),
        F.lit(True).alias("is_answerable"),
    )
    drawn = adversarial_questions(candidates.sparkSession, adversarial_count(n_items), n_chunks)
    adversarial = placed.join(drawn, "chunk_at").select(
        (F.col("j") + 1 + n_items).alias("__number"),
        "question",
        F.lit(fixed.ADVERSARIAL_ANSWER).alias("answer"),
        F.lit(fixed.TYPE_UNANSWERABLE).alias("answer_type"),
        F.lit(fixed.TYPE_UNANSWERABLE).alias("question_type"),
        *_chunk_fields(F.lit(fixed.TYPE_UNANSWERABLE)),
        F.lit("").alias("supporting_text"),
        F.lit(False).alias("is_answerable"),
    )
    return answerable.unionByName(adversarial).select(
        F.format_string("eval_%06d", "__number").alias("id"),
        *[name for name in answerable.columns if name != "__number"],
        F.lit(False).alias("multi_hop"),
    )


def _chunk_fields(question_type: Column) -> list[Column]:
    return [
        difficulty(question_type, F.col("size")).alias("difficulty"),
        F.col("document_id"),
        source_year(F.col("document_id")).alias("source_year"),
        F.col("chunk_id"),
        F.col("section_path"),
        F.col("page_start"),
        F.col("page_end"),
    ]


def question_violations(questions: DataFrame, chunks: DataFrame, target: int | None = None) -> DataFrame:
    """Number of violations of every rule a question set must keep, as one row each.

    The questions are checkpointed, since every rule reads them.
    """
    questions = reliable_checkpoint(questions)

    def total(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    joined = questions.filter("is_answerable").join(
        chunks.select("chunk_id", F.col("text").alias("__text")), "chunk_id"
    )
    text, answer = F.col("__text"), F.col("answer")
    folded = joined.select(
        normalise(text).alias("text"),
        native_normalise(text).alias("plain"),
        normalise(answer).alias("answer"),
        native_normalise(answer).alias("plain_answer"),
    )
    ungrounded = ~F.col("text").contains(F.col("answer")) & ~F.col("plain").contains(
        F.col("plain_answer")
    )
    per_document = questions.filter("is_answerable").groupBy("document_id").agg(F.count("*").alias("n"))
    rules = [
        total(folded.filter(ungrounded), "answer in chunk"),
        total(questions.groupBy("id").count().filter("count > 1"), "unique id"),
        total(
            questions.filter((strip(F.col("question")) == "") | (strip(F.col("answer")) == "")),
            "question and answer not blank",
        ),
        total(questions.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "chunk exists"),
        total(
            questions.groupBy("question", "chunk_id").count().filter("count > 1"),
            "unique question per chunk",
        ),
        total(
            per_document.filter(F.col("n") < (fixed.TARGET_PER_DOCUMENT if target is None else target)),
            "enough answerable items per document",
        ),
    ]
    result = rules[0]
    for rule in rules[1:]:
        result = result.unionByName(rule)
    return result


def question_counts(questions: DataFrame) -> DataFrame:
    """Counts by document, by type, by difficulty and in total, in one aggregation."""
    return (
        questions.groupingSets(
            [
                [F.col("document_id")],
                [F.col("question_type")],
                [F.col("difficulty")],
                [],
            ],
            "document_id",
            "question_type",
            "difficulty",
        )
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(F.col("is_answerable")).alias("n_answerable"),
        )
    )


def document_report(questions: DataFrame) -> DataFrame:
    """Answerable, unanswerable and all items per document."""
    return questions.groupBy("document_id").agg(
        F.count_if(F.col("is_answerable")).alias("answerable"),
        F.count_if(~F.col("is_answerable")).alias("unanswerable"),
        F.count("*").alias("total"),
    )
