"""Conversation history: budgets, compaction, display; context assembly and question rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lists
from marginalia.functions import text as X


def turn_tokens(user: Column, reply: Column) -> Column:
    """Words of both texts put together without a blank, by 1.3."""
    return X.token_estimate(F.concat(user, reply))


def recent(turns: DataFrame, by: list[str], order: list[str], budget: float = 2000.0) -> DataFrame:
    """The newest turns of each history whose tokens stay within the budget; the newest one always."""
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    t = turns.withColumn("tokens", turn_tokens(F.col("user_message"), F.col("assistant_response")))
    t = t.withColumn("total", F.round(F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)), 4)).withColumn("newest", F.row_number().over(newest))
    return t.filter((F.col("total") <= budget) | (F.col("newest") == 1))


def compaction(turns: DataFrame, by: list[str], order: list[str], trigger: float = 5000.0, kept: float = 2000.0, fresh: float = 3000.0) -> DataFrame:
    """One row per history: what would be done (keep or summarise), all tokens, and how many turns go into a summary.

    A history is kept under the trigger, with a summary among its newest turns, with too little new
    since its last summary, or with fewer than two turns to summarise.
    """
    oldest = Window.partitionBy(*by).orderBy(*order)
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    t = turns.withColumn("tokens", turn_tokens(F.col("user_message"), F.col("assistant_response"))).withColumn("is_summary", F.coalesce("is_summary", F.lit(False)))
    t = t.withColumn("upto", F.round(F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)), 4)).withColumn("newest", F.row_number().over(newest)).withColumn("place", F.row_number().over(oldest))
    t = t.withColumn("last_summary", F.max(F.when(F.col("is_summary"), F.col("place"))).over(Window.partitionBy(*by)))
    near = F.round(F.col("upto") - F.col("tokens"), 4) < kept
    stays = (F.col("upto") <= kept) | (F.col("newest") == 1)
    g = t.groupBy(*by).agg(
        F.round(F.sum("tokens"), 4).alias("tokens"), F.coalesce(F.bool_or(near & F.col("is_summary")), F.lit(False)).alias("summary_near"), F.max("last_summary").alias("last_summary"),
        F.round(F.coalesce(F.sum(F.when(F.col("place") > F.col("last_summary"), F.col("tokens"))), F.lit(0.0)), 4).alias("since"), F.count_if(~stays & ~F.col("is_summary")).alias("older"),
    )
    keep = (F.col("tokens") <= trigger) | F.col("summary_near") | (F.col("last_summary").isNotNull() & (F.col("since") < fresh)) | (F.col("older") < 2)
    return g.select(*by, "tokens", F.when(keep, "keep").otherwise("summarise").alias("action"), F.when(keep, 0).otherwise(F.col("older")).cast("bigint").alias("summarised_turns"))


def summarised(turns: DataFrame, by: list[str], order: list[str], kept: float = 2000.0, summarise=None, **options) -> DataFrame:
    """The histories after compaction: where it is due, the turns before the newest ones are marked as summarised, and a summary row that
    stands for them, at the place of the oldest, is added. `summarise` gives (by, text) for the marked turns; the default text is empty."""
    due = compaction(turns, by, order, kept=kept, **options).filter("action = 'summarise'").select(*(F.col(c).alias(f"_{c}") for c in by))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    t = turns.withColumns({"is_summary": F.coalesce("is_summary", F.lit(False)), "_tokens": turn_tokens(F.col("user_message"), F.col("assistant_response"))})
    t = t.withColumn("_upto", F.round(F.sum("_tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0)), 4)).withColumn("_newest", F.row_number().over(newest))
    t = t.join(due.withColumn("_due", F.lit(True)), same, "left").drop(*(f"_{c}" for c in by))
    old = F.coalesce(F.col("_due"), F.lit(False)) & ~((F.col("_upto") <= kept) | (F.col("_newest") == 1)) & ~F.col("is_summary")
    marked = t.withColumn("is_summarized", old).drop("_tokens", "_upto", "_newest", "_due")
    gone = marked.filter("is_summarized")
    counted = gone.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    text = summarise(gone).select(*by, F.col("text").alias("_text")) if summarise else None
    counted = counted.join(text, by, "left") if text is not None else counted.withColumn("_text", F.lit(""))
    own = {c: F.col(c) for c in by} | {c: F.col(f"_first.{c}") for c in order} | {
        "user_message": F.concat(F.lit("[Summary of "), "_n", F.lit(" earlier messages]")), "assistant_response": F.coalesce("_text", F.lit("")), "is_summary": F.lit(True), "is_summarized": F.lit(False),
    }
    rows = counted.select(*((own[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in marked.schema.fields))
    return marked.unionByName(rows)


def appended(turns: DataFrame, new: DataFrame) -> DataFrame:
    """The history with new turns at its end; columns that either lacks are null."""
    return turns.unionByName(new, allowMissingColumns=True)


def last_turns(turns: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The newest n turns of each history that are not cleared or summarised."""
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    shown = visible(turns, True) if {"is_cleared", "is_summarized"} <= set(turns.columns) else turns
    return shown.withColumn("_newest", F.row_number().over(newest)).filter(F.col("_newest") <= n).drop("_newest")


def display(turns: DataFrame) -> DataFrame:
    """Turns as rows of one message each, the user's first."""
    rows = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("user_message").alias("text")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("assistant_response").alias("text")))
    return turns.select("collection", "conv_id", "turn", F.explode(rows).alias("m")).select("collection", "conv_id", "turn", "m.part", "m.role", "m.text")


def cleared(turns: DataFrame, collection: str) -> DataFrame:
    """All turns of the collection flagged; those that were already count again."""
    return turns.withColumn("is_cleared", F.coalesce("is_cleared", F.lit(False)) | (F.col("collection") == collection))


def visible(turns: DataFrame, exclude_summarized: bool = False) -> DataFrame:
    shown = turns.filter(~F.coalesce(F.col("is_cleared"), F.lit(False)))
    return shown.filter(~F.coalesce(F.col("is_summarized"), F.lit(False))) if exclude_summarized else shown


def content_request(question: Column) -> Column:
    q = F.lower(question)
    return F.when(X.holds(q, lists.TABLE_REQUEST), "table").when(X.holds(q, lists.FIGURE_REQUEST), "figure").when(X.holds(q, lists.PARENT_REQUEST), "parent")


def question_class(question: Column) -> Column:
    q = F.lower(question)
    return F.when(X.holds(q, lists.VISUAL_QUESTION), "visual").when(X.holds(q, lists.COMPLEX_QUESTION), "complex").when(X.holds(q, lists.SIMPLE_QUESTION), "simple").otherwise("medium")


def chunk_content_type(page_type: Column, title: Column, content: Column) -> Column:
    t, c = F.lower(title), F.lower(content)
    piped = F.size(F.filter(F.split(c, "\n"), lambda r: F.contains(r, F.lit("|")))) >= 2
    return F.when(page_type.isin("table", "figure"), page_type).when(F.contains(t, F.lit("table")), "table").when(F.contains(t, F.lit("fig")), "figure").when(piped, "table").when(X.holds(c, lists.FIGURE_CONTENT), "figure").otherwise("text")


def of_requested_type(results: DataFrame, kind: Column) -> DataFrame:
    """Rows of the kind that was asked for, or all of a query's rows if it has none."""
    r = results.withColumn("_hit", F.coalesce(kind, F.lit(False)))
    return r.withColumn("_any", F.max("_hit").over(Window.partitionBy("query_id"))).filter("_hit or not _any").drop("_hit", "_any")


def source_line(place: Column | None = None, section: str = "toc_title") -> Column:
    """The line above a chunk in a prompt, which answers cite from; with its place where one is given."""
    told = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    head = F.lit("[Source: ") if place is None else F.concat(F.lit("[Source "), place, F.lit(": "))
    return F.concat(head, F.lit("PDF="), told("pdf_filename", "Unknown"), F.lit(", Page="), told("page_number", "?"), F.lit(", ChunkID="), told("chunk_id", "Unknown"), F.lit(", Section="), told(section, "Untitled"), F.lit("]"))


def packed_context(results: DataFrame, top: int = 6, section: str = "toc_title") -> DataFrame:
    """(query_id, chunks, context): the best chunks of each query, each below its source; a null content is empty."""
    part = F.concat(source_line(section=section), F.lit("\n"), F.coalesce("content", F.lit("")))
    best = results.filter(F.col("rank") <= top)
    return best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))).alias("l")).select("query_id", F.size("l").cast("bigint").alias("chunks"), F.array_join(F.col("l.p"), "\n\n").alias("context"))


def prompt_context(queries: DataFrame, results: DataFrame, turns: DataFrame, order: list[str], top: int = 6, newest: int = 5, section: str = "toc_title") -> DataFrame:
    """(query_id, chunks, context, turns, conversation): what a prompt holds for each query (query_id, collection).

    The conversation is the newest visible turns of the query's collection, oldest first. A query without results, and one whose collection
    has no turn, are told so.
    """
    own = last_turns(turns, ["collection"], order, newest)
    said = F.concat(F.lit("Human: "), F.coalesce("user_message", F.lit("")), F.lit("\nAssistant: "), F.coalesce("assistant_response", F.lit("")))
    spoken = own.groupBy("collection").agg(F.sort_array(F.collect_list(F.struct(*order, said.alias("_said")))).alias("l")).select(F.col("collection").alias("_c"), F.size("l").cast("bigint").alias("_turns"), F.array_join(F.col("l._said"), "\n").alias("_conversation"))
    asked = queries.select("query_id", "collection").join(packed_context(results, top, section), "query_id", "left").join(spoken, F.col("collection").eqNullSafe(F.col("_c")), "left")
    told = lambda c, other: F.coalesce(c, F.lit(other))
    return asked.select(
        "query_id", told("chunks", 0).alias("chunks"), told("context", "No specific relevant content was found in the documents.").alias("context"),
        told("_turns", 0).alias("turns"), told("_conversation", "This is the start of our conversation.").alias("conversation"),
    )


def table_text(content: Column, intended: bool = False) -> Column:
    """A table's lines with their cells trimmed and a rule below the first two of them; a content without a bar as it is.

    The rule has two columns fewer than the first line has cells that aren't empty, and comes even above one that is there already. As
    `intended`, it has as many columns as the first line and comes only where the second line is none.
    """
    def row(line: Column) -> Column:
        cells = F.regexp_replace(F.array_join(F.transform(F.split(line, r"\|"), X.stripped), "|"), r"^\|+|\|+$", "")
        return F.when(cells != "", F.concat(F.lit("| "), F.replace(cells, F.lit("|"), F.lit(" | ")), F.lit(" |"))).otherwise("")

    def ruled(lines: Column) -> Column:
        first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
        if intended:
            columns = F.size(F.split(first, r"\|")) - 2
            due = ~second.rlike(r"^\|( :?-+:? \|)+$")
        else:
            columns = F.size(F.filter(F.split(first, r"\|"), lambda c: c.rlike(r"\S"))) - 2
            due = F.lit(True)
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.greatest(columns, F.lit(0))), " | "), F.lit(" |"))
        test = (F.size(lines) >= 2) & F.contains(first, F.lit("|")) & F.contains(second, F.lit("|")) & due
        return F.when(test, F.concat(F.array(first, rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))).otherwise(lines)

    lines = F.filter(F.transform(F.split(content, "\n"), lambda r: F.when(F.contains(r, F.lit("|")), row(r)).otherwise(X.stripped(r))), lambda r: r != "")
    return F.when(F.contains(content, F.lit("|")), F.array_join(F.element_at(F.transform(F.array(lines), ruled), 1), "\n")).otherwise(content)


def within_budget(results: DataFrame, budget: float, kind: Column | None = None, section: str = "toc_title", count=X.token_estimate, spare: float = 50.0, full: float = 0.9) -> DataFrame:
    """(query_id, chunk_id, rank, used, truncated, text): the best chunks of each query as parts of a prompt, up to the budget of tokens.

    `kind` is each chunk's content type (text, table, figure; text by default): tables are set anew, figures say that they have no image. The
    first part that passes the budget ends them; if it is text and less than `full` of the budget is used, it stays with as many words, fewer by
    tens, as leave `spare` tokens free. `used` counts the tokens up to each part; a null content is empty.
    """
    content, kind = F.coalesce("content", F.lit("")), kind if kind is not None else F.lit("text")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    body = F.when(F.col("_kind") == "table", table_text(F.col("_content"))).when(F.col("_kind") == "figure", F.concat(F.lit("[FIGURE - Image not available]\n"), "_content")).otherwise(F.col("_content"))
    r = results.select("query_id", "chunk_id", "rank", content.alias("_content"), F.coalesce(kind, F.lit("text")).alias("_kind"), source_line(F.row_number().over(order), section).alias("_head"))
    r = r.withColumn("text", F.concat("_head", F.lit("\n"), body, F.lit("\n")))
    r = r.withColumn("used", F.round(F.sum(count(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), 4)).withColumn("_prior", F.coalesce(F.lag("used").over(order), F.lit(0.0)))
    words = X.words(F.col("_content"))
    short = lambda w, j: F.concat("_head", F.lit("\n"), F.array_join(F.slice(w, 1, j), " "), F.lit("... [truncated]\n"))
    fits = lambda t: F.round(count(t), 4) <= F.round(F.lit(budget) - F.col("_prior") - spare, 4)
    kept = lambda w, k: F.size(w) - 10 * k

    def cut(w: Column) -> Column:
        """The longest of the shorter texts that fits: halving the places where it may be, as fewer words are fewer tokens."""
        steps = F.ceil(F.size(w) / 10).cast("int")
        ends = F.struct(F.lit(0).alias("low"), steps.alias("high"))

        def half(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            fit = fits(short(w, kept(w, middle)))
            return F.when(s["low"] >= s["high"], s).when(fit, F.struct(s["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), s["high"].alias("high")))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), ends, half, lambda s: s["low"])
        return F.element_at(F.transform(F.array(found), lambda k: F.when(k < steps, short(w, kept(w, k)))), 1)

    last = (F.col("used") > budget) & (F.col("_prior") <= budget) & (F.col("_kind") == "text") & (F.col("_prior") < budget * full)
    r = r.withColumn("_cut", F.when(last, F.element_at(F.transform(F.array(words), cut), 1))).filter((F.col("used") <= budget) | F.col("_cut").isNotNull())
    used = F.when(F.col("_cut").isNull(), F.col("used")).otherwise(F.round(F.col("_prior") + count(F.col("_cut")), 4))
    return r.select("query_id", "chunk_id", "rank", used.alias("used"), F.col("_cut").isNotNull().alias("truncated"), F.coalesce("_cut", "text").alias("text"))


def distinct_sources(results: DataFrame) -> DataFrame:
    """Each chunk of several answers once, from the first answer and its best rank there."""
    order = Window.partitionBy("query_id", "chunk_id").orderBy("answer", "rank")
    return results.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
