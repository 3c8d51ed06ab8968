"""File trees: name search, path scope and exclusion, listing and tree order, two listings matched, manifests."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.functions import text as T
from almanak.plans.paging import TreePlace, page_size


def glob_pattern(glob: str) -> str:
    """A whole-name pattern of ``*`` and ``?`` as a regular expression for the JVM."""
    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(c, re.sub(r"([^\w\s])", r"\\\1", c)) for c in glob) + "$"


def fold(text: str) -> str:
    """The form under which names and paths are the same, as ``functions.text.folded``: composed, in small letters."""
    return unicodedata.normalize("NFC", text).lower()


def name_matches(key: Column, asked: str) -> Column:
    """Substring of the folded name, or the whole of it where ``*`` or ``?`` occur; ``asked`` is folded alike."""
    asked = fold(asked)
    return key.rlike(glob_pattern(asked)) if re.search(r"[*?]", asked) else F.contains(key, F.lit(asked))


def within(path_key: Column, top: str) -> Column:
    """Whether a folded path lies under a folder; ``/`` is everything."""
    top = fold(top).rstrip("/")
    return F.lit(True) if not top else path_key.startswith(top + "/")


def excluded(path_key: Column, folders: list[str]) -> Column:
    """Equal to, or under, an excluded folder; excluding ``/`` hides all."""
    out = F.lit(False)
    for f in folders:
        f = fold(f).rstrip("/")
        out = out | (F.lit(True) if not f else ((path_key == f) | path_key.startswith(f + "/")))
    return out


def hidden_name(path: Column) -> Column:
    """A name that begins with a dot, or lies below one."""
    return path.rlike(r"(^|/)\.")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def plain_path(path: Column) -> Column:
    """The path with single slashes and none at the end; null if a step is ``.`` or ``..``."""
    p = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    return F.when(~p.rlike(r"(^|/)\.{1,2}(/|$)"), p)


def search_entries(entries: DataFrame, asked: str, top: str = "/", kind: str | None = None, after: str | None = None, before: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Entries (``path``, ``key``, ``path_key``, ``kind``, ``modified``) that match a name under a folder, by kind and date; undated ones match no date."""
    c = name_matches(F.col("key"), asked) & within(F.col("path_key"), top) & ~excluded(F.col("path_key"), exclude or []) & ~hidden_name(F.col("path"))
    if kind is not None:
        c = c & ((F.col("kind") == "folder") if kind == "folder" else (F.col("kind") != "folder"))
    if after is not None:
        c = c & (F.col("modified") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        c = c & (F.col("modified") < F.lit(before).cast("timestamp_ntz"))
    return entries.filter(F.coalesce(c, F.lit(False)))


def listing_order() -> list[Column]:
    """Folders first, then by folded name."""
    return [F.when(F.col("kind") == "folder", 0).otherwise(1).asc(), F.asc("key"), F.asc("path")]


def _steps(folded: Column, exact: Column) -> Column:
    """The steps of a folder's path as pairs of folded and exact name: compared one by one, so that a folder comes before what is below it."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    return F.arrays_zip(parts(folded).alias("a"), parts(exact).alias("b"))


def tree_order() -> list[Column]:
    """Depth first: the folder's steps, compared one by one, then folded and exact name."""
    return [_steps(parent(F.col("path_key")), parent(F.col("path"))).asc(), F.asc("key"), F.asc("path")]


def tree_page(entries: DataFrame, size: int, after: TreePlace | None = None) -> DataFrame:
    """A page of the tree with ``folder`` and ``row_no``, its place in the page, from a place on.

    The place holds while the tree changes: a folder that is gone is passed by,
    and one that came after the place is listed.
    """
    rows = entries.withColumn("folder", parent(F.col("path")))
    skip = after.skip if after else 0
    if after:
        here = _steps(F.lit(fold(after.folder)), F.lit(after.folder))
        rows = rows.filter(_steps(parent(F.col("path_key")), F.col("folder")) >= here)
    rows = rows.orderBy(*tree_order()).limit(size + skip)
    if skip:
        # over at most one page and what is skipped
        at = F.row_number().over(W.partitionBy("folder").orderBy("key", "path"))
        rows = rows.withColumn("_at", at).filter((F.col("folder") != after.folder) | (F.col("_at") > skip)).drop("_at").orderBy(*tree_order()).limit(size)
    return rows.withColumn("row_no", F.row_number().over(W.orderBy(*tree_order())).cast("bigint")).orderBy("row_no")


def next_place(page: DataFrame, after: TreePlace | None = None) -> TreePlace | None:
    """The place after a page's last row; none for an empty page."""
    last = page.orderBy(F.desc("row_no")).select("folder").limit(1).collect()
    if not last:
        return None
    folder = last[0].folder
    n = page.filter(F.col("folder") == folder).count()
    return TreePlace(folder, n + (after.skip if after and after.folder == folder else 0))


def children(entries: DataFrame, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """What stands directly in a folder, excluded entries left out."""
    return entries.filter((parent(F.col("path_key")) == fold(folder).rstrip("/")) & ~excluded(F.col("path_key"), exclude or []))


def list_folder(entries: DataFrame, folder: str, exclude: list[str] | None = None, offset: int = 0, size: int | None = None) -> DataFrame:
    """A page of a folder's entries, folders first, then by folded name, with ``row_no``; names that begin with a dot are hidden."""
    rows = children(entries, folder, exclude).filter(~name(F.col("path")).startswith("."))
    rows = rows.orderBy(*listing_order()).offset(offset).limit(page_size("folder", size))
    return rows.withColumn("row_no", F.row_number().over(W.orderBy(*listing_order())).cast("bigint") + offset).orderBy("row_no")


def hidden_names(entries: DataFrame, folder: str, exclude: list[str] | None = None) -> DataFrame:
    """``hidden_names``, one row: how many names of a folder are hidden; excluded ones are not counted."""
    return children(entries, folder, exclude).agg(F.count_if(name(F.col("path")).startswith(".")).alias("hidden_names"))


def usage(entries: DataFrame) -> DataFrame:
    """``files``, ``bytes``, one row."""
    return entries.filter("kind <> 'folder'").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def entry_view(entries: DataFrame, placeholders: dict[str, str] | None = None) -> DataFrame:
    """Entries as a list shows them: escaped path and name, no size for folders, the time of the last change in UTC, and what a placeholder stands for."""
    own = T.escaped(name(F.col("path")))
    return entries.select(
        T.escaped(F.col("path")).alias("path"), own.alias("name"), "kind", F.when(F.col("kind") != "folder", F.col("size")).alias("size"),
        F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), T.placeholder_class(F.col("path"), placeholders or {}).alias("stands_for"))


#: Entries that a walk of a folder gives before it says that it is not complete.
MOST_WALKED = 300_000


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Entries below a folder of any file system Spark reads: ``path`` from the root on, ``kind``, ``size``, ``modified``, ``key``, ``path_key``.

    Contents are not read. Folders are those that hold files; names that begin
    with a dot, and excluded folders, are not entered.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("url"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    whole = F.regexp_replace(F.col("url"), r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?(?=/)", "")
    top = re.sub(r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?(?=/)", "", root).rstrip("/")
    files = files.select(F.substring(whole, len(top) + 1, 1 << 20).alias("path"), F.lit("file").alias("kind"), "size", "modified").filter(~hidden_name(F.col("path")))
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 2), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k + 1), "/"))
    folders = files.filter(F.size(F.split("path", "/")) > 2).select(F.explode(ups).alias("path")).distinct()
    folders = folders.select("path", F.lit("folder").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp_ntz").alias("modified"))
    rows = files.unionByName(folders)
    rows = rows.withColumn("name", name(F.col("path"))).withColumn("key", T.folded("name")).withColumn("path_key", T.folded("path"))
    return rows.filter(~excluded(F.col("path_key"), exclude or []))


def walk_complete(entries: DataFrame, most: int = MOST_WALKED) -> DataFrame:
    """``entries``, ``complete``, one row: how many there are, and whether an index of ``most`` holds them all."""
    return entries.agg(F.count("*").alias("entries")).withColumn("complete", F.col("entries") <= most)


class Index:
    """Entries kept for ``seconds`` once they have been walked, then walked anew."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self._held: tuple[float, DataFrame] | None = None

    def entries(self) -> DataFrame:
        now = self.clock()
        if self._held is None or now - self._held[0] >= self.seconds:
            if self._held is not None:
                self._held[1].unpersist()
            self._held = now, self.make().cache()
        return self._held[1]


def collisions(entries: DataFrame) -> DataFrame:
    """Folded names that several entries of a folder have."""
    return entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def reconcile(local: DataFrame, remote: DataFrame, on: str = "key", exact: str = "name") -> DataFrame:
    """Two listings matched by folded name, each row once, with ``why``.

    One remote entry of a name matches the first local one; of several only
    one whose exact name is equal, for nothing is guessed. What is left over
    gives a row: ``only local``, ``only remote`` or ``ambiguous``.
    """
    lw, rw = W.partitionBy(on).orderBy(exact, "local_id"), W.partitionBy(on, exact).orderBy("remote_id")
    r = remote.select(on, F.col(exact).alias("remote_name"), "remote_id").withColumn("n_remote", F.count("*").over(W.partitionBy(on)))
    r = r.withColumn("n_exact", F.count("*").over(W.partitionBy(on, "remote_name")))
    l = local.select(on, F.col(exact).alias("local_name"), "local_id").withColumn("rank", F.row_number().over(W.partitionBy(on).orderBy("local_name", "local_id")))
    l = l.withColumn("exact_rank", F.row_number().over(W.partitionBy(on, "local_name").orderBy("local_id")))
    single = r.filter("n_remote = 1").select(on, F.col("remote_id").alias("single_id"), F.lit(1).alias("rank"))
    precise = r.filter("n_remote > 1 and n_exact = 1").select(on, F.col("remote_name").alias("local_name"), F.col("remote_id").alias("exact_id"), F.lit(1).alias("exact_rank"))
    several = r.select(on, "n_remote").distinct()
    m = l.join(single, [on, "rank"], "left").join(precise, [on, "local_name", "exact_rank"], "left").join(several, on, "left")
    m = m.withColumn("remote_id", F.coalesce("single_id", "exact_id"))
    why = F.when(F.col("remote_id").isNotNull(), "matched").when(F.col("n_remote") > 1, "ambiguous").otherwise("only local")
    matched = m.select(on, "local_id", "remote_id", why.alias("why"))
    rest = r.join(matched.filter("remote_id is not null").select("remote_id"), "remote_id", "left_anti")
    return matched.unionByName(rest.select(on, F.lit(None).cast("bigint").alias("local_id"), "remote_id", F.lit("only remote").alias("why")))


def digest_matches(content: Column, claimed: Column) -> Column:
    """Whether a claimed SHA-1 (kept only if it is 40 hex digits) is the content's, case aside."""
    fit = F.when(claimed.rlike("^[0-9A-Fa-f]{40}$"), F.lower(claimed))
    return F.sha1(content.cast("binary")) == fit


def folder_print(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


MANIFEST = ["path", "kind", "size", "modified", "sha256"]


def write_manifest(entries: DataFrame, folder: str, append: bool = False) -> DataFrame:
    """The tree in order as JSON lines in a folder; gives the ``sha256`` of each file written, by name.

    Without ``append`` an existing folder is refused. Spark commits a write as
    a whole, so nothing stands there unless every row was listed. Columns that
    entries lack are left out.
    """
    rows = entries.orderBy(*tree_order()).select(*[c for c in MANIFEST if c in entries.columns])
    rows.write.mode("append" if append else "errorifexists").json(folder)
    return manifest_digests(entries.sparkSession, folder)


def manifest_page(entries: DataFrame, folder: str, size: int, after: TreePlace | None = None) -> TreePlace | None:
    """Writes the next ``size`` rows of a manifest and gives the place to go on from; none once the tree is at its end.

    The first page makes the folder, later ones add to it.
    """
    page = tree_page(entries, size, after).cache()
    try:
        n = page.count()
        if n or after is None:
            page.orderBy("row_no").select(*[c for c in MANIFEST if c in page.columns]).coalesce(1).write.mode("errorifexists" if after is None else "append").json(folder)
        return next_place(page, after) if n == size else None
    finally:
        page.unpersist()


def manifest_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``file``, ``rows``, ``sha256`` of each part of a manifest."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return parts.select(F.substring_index("path", "/", -1).alias("file"), (F.length(F.col("content").cast("string")) - F.length(F.translate(F.col("content").cast("string"), "\n", ""))).cast("bigint").alias("rows"), F.sha2("content", 256).alias("sha256"))
