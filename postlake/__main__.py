"""Commands over mail archives: list, stats, index, find, export. See README.md."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import listing_bound
from .operators import filters, search, stats
from .operators.index import Index
from .operators.runs import Cancelled, watched
from .sinks import messages as sink
from .sinks.export import log_lines, summary
from .sources import extract, files, mbox, mime
from .sources.tree import listed


def opened(spark: SparkSession, uri: str, head_only: bool = False) -> DataFrame:
    """Raw messages of one file, by its extension or how it begins, or of a tree of message files and mboxes."""
    system, found = listed(uri)
    if not found:
        raise FileNotFoundError(uri)
    if len(found) == 1 and found[0][0] == pathname(uri):
        with system.open_input_stream(found[0][0]) as f:
            kind = files.kind_of_file(found[0][0], f.read(256))
        if kind == "mbox":
            return mbox.read_mbox(spark, uri, head_only=head_only)
        if kind not in ("eml", "emlx"):
            raise ValueError(f"{uri}: {kind or 'no kind of mail'} can't be read")
        return files.read_files(spark, uri, head_only)
    return files.read_files(spark, uri, head_only).unionByName(mbox.read_mbox(spark, uri, head_only=head_only), allowMissingColumns=True)


def pathname(uri: str) -> str:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)[1]


def open_sources(spark: SparkSession, uris: list[str], heads: bool = False) -> DataFrame | None:
    """The messages (or only the listing's fields) of all sources; one that is missing or unknown is a warning."""
    rows = None
    for uri in dict.fromkeys(uris):
        try:
            raw = opened(spark, uri, heads)
        except (OSError, ValueError) as e:
            print(f"warning: {e}", file=sys.stderr)
            continue
        one = mime.heads(raw) if heads else mime.messages(raw)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def filtered(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    if a.folder:
        rows = filters.folder_subtree(rows, a.folder)
    f = filters.RowFilter(a.search, a.search_bodies, a.since, a.until, a.has_attachments, a.attachment_kind, a.contacts_only, a.only_mail)
    return f.apply(rows, mime.attachments(rows) if "attachments" in rows.columns else None)


def indexed(rows: DataFrame) -> DataFrame:
    return extract.with_attachment_text(rows.drop("raw", "html"))


#: Marks words of a query that look like options.
TERM = "\x00"


def terms(argv: list[str]) -> list[str]:
    """A word such as -newsletter is an excluded term, also where an option begins with its letter."""
    known = {"-n", "--limit", "--json", "--export", "--format", "-h", "--help"}
    return [TERM + w if w.startswith("-") and w.partition("=")[0] not in known else w for w in argv]


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="postlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "stats", "export"):
        c = sub.add_parser(name)
        c.add_argument("sources", nargs="+")
        c.add_argument("--out", default="")
        c.add_argument("--format", default="eml", choices=["eml", "mbox", "txt", "html", "attachments"])
        for option in ("folder", "search", "extensions"):
            c.add_argument(f"--{option}", default="")
        for option in ("since", "until"):
            c.add_argument(f"--{option}")
        for option in ("search-bodies", "has-attachments", "contacts-only", "only-mail", "skip-inline"):
            c.add_argument(f"--{option}", action="store_true")
        c.add_argument("--attachment-kind", default="all", choices=["all", "documents", "images", "archives", "other"])
    c = sub.add_parser("index")
    c.add_argument("db")
    c.add_argument("sources", nargs="*")
    for option in ("force", "clear", "stats", "prune", "optimize"):
        c.add_argument(f"--{option}", action="store_true")
    c.add_argument("--remove", default="")
    c = sub.add_parser("find")
    c.add_argument("db")
    c.add_argument("query", nargs="+")
    c.add_argument("-n", "--limit", type=int, default=200)
    c.add_argument("--json", action="store_true")
    c.add_argument("--export", default="")
    c.add_argument("--format", default="json", choices=["json", "eml", "mbox", "txt", "html"])
    a = p.parse_args(terms(argv) if argv[:1] == ["find"] else argv)
    for text in (getattr(a, "since", None), getattr(a, "until", None)):
        if text and not listing_bound(text):
            print(f"not a date: {text}", file=sys.stderr)
            return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("index", "export"):
        # Both may take long: they show how far they are, and an interrupt leaves a state from which they go on.
        work = (lambda: index(spark, a)) if a.command == "index" else (lambda: listing(spark, a))
        try:
            return watched(spark, work, a.command, lambda p: print(f"\r{p.done} of {p.tasks} tasks", end="", file=sys.stderr, flush=True), every=2.0)
        except Cancelled:
            print("stopped", file=sys.stderr)
            return 130
    if a.command == "find":
        return find(spark, a, " ".join(w.removeprefix(TERM) for w in a.query))
    return listing(spark, a)


def listing(spark: SparkSession, a: argparse.Namespace) -> int:
    """The commands over messages themselves: list, stats, export."""
    # Lists read no message beyond its header block, unless bodies or attachments are asked for.
    heads = a.command == "list" and not a.search_bodies and a.attachment_kind == "all"
    rows = open_sources(spark, a.sources, heads)
    if rows is None:
        return 2
    rows = filtered(rows, a)
    if a.command == "list":
        rows.groupBy("source_name", "folder").agg(F.count("*").alias("messages"), F.count_if(~F.col("is_read")).alias("unread")).orderBy("folder").show(1000, False)
    elif a.command == "stats":
        rows = rows.drop("raw", "html", "body").persist()
        reports = stats.compute(rows, mime.attachments(rows).select("nid", "filename", "is_inline", "size"))
        if a.out:
            sink.write_reports(reports, a.out)
            sink.write_report_page(reports, f"{a.out}/report.html")
        for name, df in reports.items():
            print(f"\n{name}")
            df.show(100, False)
    else:
        export(rows, a)
    return 0


def export(rows: DataFrame, a: argparse.Namespace) -> None:
    per_source = len(dict.fromkeys(getattr(a, "sources", []))) > 1
    if a.format == "mbox":
        sink.write_mbox(rows, a.out)
        return
    if a.format == "attachments":
        kept = filters.wanted_attachments(mime.attachments(rows), a.extensions, () if a.attachment_kind == "all" else (a.attachment_kind,), a.skip_inline)
        folder = F.concat(F.col("nid").cast("string"), F.lit("/"), F.col("att_no").cast("string"), F.lit(" "), sink.sanitize(F.col("filename")))
        content = kept.select((F.concat(sink.sanitize(F.col("source_name")), F.lit("/"), folder) if per_source else folder).alias("path"), F.col("data").alias("content"))
    else:
        make = {"eml": sink.as_eml, "txt": sink.as_text, "html": sink.as_html}[a.format]
        content = make(sink.output_paths(rows, a.format, per_source=per_source))
        sink.write_index(content.drop("raw", "html", "attachments"), a.out)
    log = sink.write_files(content, a.out)
    for r in log_lines(log).limit(20).collect():  # the rest is in the log
        print(f"warning: {r['line']}", file=sys.stderr)
    done = summary(log).first()
    print(f"{done['exported']} exported, {done['failed']} failed")


#: What an index keeps of where a message lies, so that hits can be read from their sources.
PLACE = {"path": "string", "offset": "long", "kind": "string", "flag_read": "boolean"}


def stored(new: DataFrame, uri: str) -> DataFrame:
    """Whole messages of listing rows as the index stores them, with their places."""
    places = new.select("source_name", "nid", F.lit(uri.rstrip("/")).alias("uri"), *PLACE)
    return indexed(mime.messages(files.contents(new, uri))).join(places, ["source_name", "nid"])


def whole(hits: DataFrame) -> DataFrame:
    """The messages of hits as they are in their sources now; of those that are gone there is a row with an error."""
    uris = [r["uri"] for r in hits.select("uri").distinct().collect()]  # sources of at most the limit of hits
    return reduce(DataFrame.unionByName, [mime.messages(files.contents(hits.where(F.col("uri") == u), u)) for u in uris])


def label(idx: Index, uri: str) -> str:
    """The name of a source in the index: its last component, or its whole path where another place has that name already."""
    base, rows = uri.rstrip("/").rpartition("/")[2], idx.messages()
    if rows is None or "uri" not in rows.columns:
        return base
    return pathname(uri).rstrip("/") if rows.where((F.col("source_name") == base) & (F.col("uri") != uri.rstrip("/"))).take(1) else base


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    idx, failed, present = Index(spark, a.db), 0, []
    if a.clear:
        idx.clear()
    if a.remove:
        print(f"removed {idx.remove(a.remove)} messages")
    for uri in a.sources:
        try:
            raw = opened(spark, uri, head_only=True)
            state = [(size, changed) for _, changed, size in listed(uri)[1]]
        except (OSError, ValueError) as e:
            print(f"warning: {e}", file=sys.stderr)
            failed += 1
            continue
        name, size, mtime = label(idx, uri), sum(s for s, _ in state), max((t or 0 for _, t in state), default=0) / 1e6
        present.append((name,))
        if not a.force and idx.is_current(name, size, mtime):
            print(uri, "unchanged")
            continue
        # Keys come from header blocks; whole messages are read of those that are new. What couldn't be opened this time
        # is no message and removes none.
        raw = raw.withColumn("source_name", F.lit(name))
        places = raw.select("source_name", "nid", "path", "offset" if "offset" in raw.columns else F.lit(None).cast("long").alias("offset"), "kind", "flag_read", F.col("error").isNotNull().alias("unread"))
        heads = mime.heads(raw).join(places, ["source_name", "nid"])
        prints = spark.createDataFrame([(name, size, mtime)], "source_name string, size long, mtime double")
        print(uri, idx.update(heads, prints, a.force, texts=lambda new, uri=uri: stored(new, uri)))
    if a.prune and not failed:
        print("removed", *idx.prune(spark.createDataFrame(present, "source_name string")))
    if a.optimize:
        idx.optimize()
    if a.stats and idx.messages() is not None:
        idx.statistics().show()
        idx.sources().show(1000, False)
    return 1 if failed and failed == len(a.sources) else 0


def find(spark: SparkSession, a: argparse.Namespace, query: str) -> int:
    hits = search.with_snippets(Index(spark, a.db).ranked(query, limit=a.limit), query).persist()
    if a.export and a.format == "json":
        sink.hits_json(hits).select("json").write.mode("overwrite").text(a.export)
    elif a.export and hits.take(1):
        export(whole(hits), argparse.Namespace(format=a.format, out=a.export))
    out = sink.hits_json(hits).collect() if a.json else hits.select("date", "sender", "subject", "folder", "matched_in", "snippet").collect()  # at most the limit
    for r in out:
        print(r["json"] if a.json else "  ".join(str(v or "") for v in r))
    return 0 if out else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
