"""Packages and ledgers held against what was collected: identity, originals by hash, audit overlays, ledger rules.

Every check is a join or an aggregation on the checked key. Counts come from aggregations that combine before the shuffle and
are joined back, not from windows, so that a hot address or package is split like any other join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An issue ends at this hour in this offset from UTC and covers a day before; a package holds at most MOST articles; a request at
#: most ASKED originals.
END_HOUR, OFFSET_HOURS, MOST, ASKED = 6, 8, 20, 5


def issue_end(issue: Column) -> Column:
    """The end in UTC of the issue of a day written as yyyy-MM-dd, null for any other writing."""
    day = F.try_to_timestamp(F.when(issue.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), issue), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    return day + F.expr(f"make_dt_interval(0, {END_HOUR - OFFSET_HOURS})")


def issue_of(at: Column) -> Column:
    """The issue that a time in UTC belongs to: its window takes its start and leaves its end out."""
    return F.date_format(at + F.expr(f"make_dt_interval(1, {OFFSET_HOURS - END_HOUR})"), "yyyy-MM-dd")


def package_digests(articles: DataFrame) -> DataFrame:
    """articles (package, id, text) -> (package, n, repeats, digest): rows, repeated or missing ids, and the hash over
    `id:sha256 of text` lines by id, null where a package has more than MOST rows: those are not gathered."""
    rows = articles.select("package", "id", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"))
    each = rows.groupBy("package", "id").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("package").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.col("n") - 1)).alias("repeats"))
    few = rows.join(counts.filter(F.col("n") <= MOST).select("package"), "package", "left_semi")
    digests = few.groupBy("package").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n"), 256).alias("digest"))
    return counts.join(digests, "package", "left")


def handoff_errors(packages: DataFrame, articles: DataFrame) -> DataFrame:
    """packages (package, issue, window_start, window_end, ready, writer, body_hash) -> (package, n, error): the first of window,
    not_final, ids, count and hash that holds; null if the package may be taken."""
    end = issue_end(F.col("issue"))
    exact = (F.col("window_end") == end) & (F.col("window_start") == end - F.expr("interval '1' day"))
    found = packages.join(package_digests(articles), "package", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    error = (
        F.when(~F.coalesce(exact, F.lit(False)), "window").when(~F.coalesce(F.col("ready"), F.lit(False)) | (F.trim(F.coalesce("writer", F.lit(""))) == ""), "not_final")
        .when(F.coalesce("repeats", F.lit(0)) > 0, "ids").when(~F.col("n").between(1, MOST), "count").when(~F.col("body_hash").eqNullSafe(F.col("digest")), "hash")
    )
    return found.select("package", "n", error.alias("error"))


def bound_originals(asked: DataFrame, ledger: DataFrame, index: DataFrame, archive: DataFrame) -> DataFrame:
    """Each asked id with the first thing that keeps its original from being used, or null: (request, id, error).

    asked: request, id. ledger: id, validated, fingerprint, path, file_hash, text_hash. index: id, fingerprint, as the request saw
    it. archive: path, raw, text. A request must name one to ASKED different ids, else all its rows have the error request. The
    three hashes are the fingerprint, that of the archived file and that of its text; an empty text fails the last one.
    """
    each = asked.groupBy("request", "id").agg(F.count(F.lit(1)).alias("times"))
    sizes = each.groupBy("request").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("different"), F.count_if(F.col("id").isNull()).alias("unnamed"))
    fair = (F.col("n") <= ASKED) & (F.col("n") == F.col("different")) & (F.col("unnamed") == 0)
    rows = each.select("request", "id").join(sizes.select("request", fair.alias("fair")), "request")
    known = ledger.select("id", "validated", "fingerprint", "path", "file_hash", "text_hash", F.lit(True).alias("entered"))
    seen = index.select("id", F.col("fingerprint").alias("seen"))
    hashes = archive.select("path", F.sha2("raw", 256).alias("raw_hash"), F.when(F.trim("text") != "", F.sha2("text", 256)).alias("body_hash"), F.lit(True).alias("archived"))
    met = rows.join(known, "id", "left").join(seen, "id", "left").join(hashes, "path", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(~F.col("fair"), "request").when(no(F.col("entered")), "not_in_ledger").when(no(F.col("validated")), "not_validated").when(no(F.col("fingerprint") == F.col("seen")), "evidence_changed")
        .when(no(F.col("archived")), "archive_missing").when(no(F.col("raw_hash") == F.col("file_hash")), "file_changed").when(no(F.col("body_hash") == F.col("text_hash")), "text_changed")
    )
    return met.select("request", "id", error.alias("error"))


def latest_events(events: DataFrame, *fields: str) -> DataFrame:
    """Of each event id the last row by (at, seq)."""
    return events.groupBy("event").agg(F.max_by(F.struct(*fields), F.struct("at", "seq")).alias("e")).select("event", *(F.col(f"e.{f}").alias(f) for f in fields))


def overlaid(ledger: DataFrame, decisions: DataFrame, adopted: DataFrame) -> DataFrame:
    """The ledger with the latest decisions laid over it: (id, decision, reason, adopted, error).

    ledger: id, decision, reason, disclosed. decisions: event (the entry's id), at, seq, decision, reason, disclosed, of which a
    null leaves the entry's own value. adopted: id. A decided entry must be selected if it is adopted and rejected if not; an
    adopted entry must be selected with its first disclosure verified.
    """
    last = latest_events(decisions, "decision", "reason", "disclosed").select(F.col("event").alias("id"), *(F.col(c).alias("new_" + c) for c in ("decision", "reason", "disclosed")), F.lit(True).alias("decided"))
    taken = adopted.select("id").distinct().withColumn("adopted", F.lit(True))
    rows = ledger.join(last, "id", "left").join(taken, "id", "left").select("id", *(F.coalesce("new_" + c, c).alias(c) for c in ("decision", "reason", "disclosed")), F.coalesce("decided", F.lit(False)).alias("decided"), F.coalesce("adopted", F.lit(False)).alias("adopted"))
    due = F.when(F.col("adopted"), "selected").otherwise("rejected")
    selected = F.coalesce(F.col("decision") == "selected", F.lit(False))
    error = F.when(F.col("decided") & ~F.col("decision").eqNullSafe(due), "selection_mismatch").when(F.col("adopted") & ~(selected & F.coalesce("disclosed", F.lit(False))), "no_first_disclosure")
    return rows.select("id", "decision", "reason", "adopted", error.alias("error"))


DECISIONS = ("selected", "rejected", "pending")


def ledger_errors(ledger: DataFrame, articles: DataFrame, records: DataFrame) -> DataFrame:
    """Every rule that a ledger breaks: (kind, key), key being an id, or an address where the row has none.

    ledger: id, url, decision, reason, discovered_at, start, stop, text_at. articles, those adopted: id, url. records of
    successful full texts: url, at. Ids and addresses are unique on both sides, a decision is one of DECISIONS and not pending, a
    decided row has a reason, a row is discovered within start and stop, a stated text has a record of that time and a selected
    row has one, selected addresses are the adopted ones, and every recorded text is in the ledger.
    """
    key = F.coalesce(F.col("id").cast("string"), F.col("url"), F.lit(""))
    flag = lambda rows, kind, on=key: rows.select(F.lit(kind).alias("kind"), on.alias("key"))

    def repeated(rows: DataFrame, column: str) -> DataFrame:
        # all rows but the first of a value, counted: the value stands for them
        return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNull() | (F.col("n") > 1)).select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key"))

    out = repeated(ledger, "id").select(F.lit("id_repeated").alias("kind"), "key")
    for rows, kind, column in ((ledger, "url_repeated", "url"), (articles, "adopted_id_repeated", "id"), (articles, "adopted_url_repeated", "url")):
        out = out.union(repeated(rows, column).select(F.lit(kind), "key"))
    known = F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))
    decided = known & (F.col("decision") != "pending")
    selected = known & (F.col("decision") == "selected")
    simple = {
        "decision_unknown": ~known, "pending": known & (F.col("decision") == "pending"), "no_reason": decided & (F.trim(F.coalesce("reason", F.lit(""))) == ""),
        "discovered_outside": ~F.coalesce(F.col("discovered_at").between(F.col("start"), F.col("stop")), F.lit(False)), "selected_without_text": selected & F.col("text_at").isNull(),
    }
    out = out.union(ledger.select(key.alias("key"), F.explode(F.array_compact(F.array(*(F.when(test, F.lit(kind)) for kind, test in simple.items())))).alias("kind")).select("kind", "key"))
    stated = ledger.filter(known & F.col("text_at").isNotNull())
    out = out.union(flag(stated.join(records.select("url", F.col("at").alias("text_at")), ["url", "text_at"], "left_anti"), "text_without_record"))
    chosen, taken = (rows.filter("url is not null").select("url").distinct() for rows in (ledger.filter(selected), articles))
    out = out.union(chosen.join(taken, "url", "left_anti").select(F.lit("selected_not_adopted"), "url")).union(taken.join(chosen, "url", "left_anti").select(F.lit("adopted_not_selected"), "url"))
    return out.union(records.select("url").distinct().join(ledger.select("url"), "url", "left_anti").select(F.lit("text_not_in_ledger"), "url"))
