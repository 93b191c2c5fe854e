"""Reading benchmark datasets of many column layouts into one schema of instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.functions.repos import canonical_repo

#: Names under which datasets keep each column, in order of preference.
ALIASES = {
    "instance_id": "instance_id id task_id problem_id name".split(),
    "repo": "repo repository source_repo project".split(),
    "patch": "patch fix_patch solution canonical_solution gold_patch answer code reference_solution".split(),
    "problem_statement": "problem_statement body description prompt text question instruct_prompt".split(),
    "test_patch": "test_patch tests test test_list test_code".split(),
    "base_commit": "base_commit commit_id base_sha".split(),
    "created_at": "created_at created date".split(),
}
#: What each kind of audit can't do without.
REQUIRED = {"consensus": ("instance_id", "repo", "base_commit", "patch"), "pr_diff": ("instance_id", "repo", "patch"), "solution": ("instance_id", "patch")}
PR_COLUMNS = "pr_number pull_number number".split()
#: Columns that may hold the link of a pull request, the first that does counts.
URL_COLUMNS = "pr_url pull_request_url pull_url github_pr_url html_url url".split()
LANGUAGE_COLUMNS = "language lang".split()


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first sign of a JSON file opens an array; only the beginning of the file is read."""
    first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    return bool(first) and first[0][0].lstrip("\ufeff \t").startswith("[")


def read_rows(spark: SparkSession, path: str, lenient: bool = False, array: bool | None = None) -> DataFrame:
    """A Parquet, JSON-lines or JSON-array source by its suffix; malformed lines fail, or are left out if ``lenient``.

    A .json file is looked at to tell an array from lines, unless ``array`` says which.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if not name.endswith((".jsonl", ".ndjson", ".json")):
        raise ValueError(f"unknown format: {path}")
    if name.endswith(".json") and (_is_array(spark, path) if array is None else array):
        return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)
    return spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The columns of a source; of Parquet from the footer, of JSON from its first lines."""
    return spark.read.parquet(path).columns if path.rstrip("/").lower().endswith(".parquet") else read_rows(spark, path, lenient=True).columns


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the data files under a folder, the largest first; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,jsonl,ndjson,json}").load(folder)
    return files.select("path", "length").orderBy(F.desc("length"), "path")


def largest_file(spark: SparkSession, folder: str) -> str | None:
    first = data_files(spark, folder).limit(1).collect()
    return first[0].path if first else None


def head(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order; without one 'first' means nothing in a distributed table."""
    if n < 1 or not order:
        raise ValueError("a positive number of rows and an order are needed")
    return rows.orderBy(*order).limit(n)


def sample_size(text: str | int | None) -> int | None:
    """A number of rows to sample, None for all of them; zero, negative and other texts are refused."""
    if text is None or str(text).strip() == "":
        return None
    if not str(text).strip().isdigit() or int(text) < 1:
        raise ValueError("a sample must be a positive whole number")
    return int(text)


def check_required(columns: list[str], kind: str, declared: dict[str, str] | None = None) -> None:
    """Raises with the names that an audit of the ``kind`` misses under any alias."""
    found = resolve(columns, declared)
    missing = [c for c in REQUIRED[kind] if c not in found]
    if missing:
        raise ValueError(f"{kind} needs columns for {', '.join(missing)}")


def group_key(df: DataFrame) -> Column:
    """Language and repository of raw rows, as far as there are columns for them; '__all__' if there is nothing."""
    one = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns], F.lit(None).cast("string"))
    repo = one(["repo", "repository", "source_repo"])
    org = one(["org"])
    repo = F.when(org.isNotNull() & ~repo.contains("/"), F.concat(org, F.lit("/"), repo)).otherwise(repo)
    return F.coalesce(F.nullif(F.concat_ws("/", one([*LANGUAGE_COLUMNS, "_language"]), repo), F.lit("")), F.lit("__all__"))


def read_shards(spark: SparkSession, paths: list[str], **how) -> DataFrame:
    """Shards of one dataset as one table; a column that a shard lacks is null there."""
    frames = [read_rows(spark, p, **how) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def resolve(columns: list[str], declared: dict[str, str] | None = None) -> dict[str, str]:
    """Which column holds what: declared names win, then exact aliases, then aliases whatever their case."""
    found = {k: v for k, v in (declared or {}).items() if v in columns}
    lower = {c.lower(): c for c in reversed(columns)}
    for name, aliases in ALIASES.items():
        if name not in found:
            hit = next((a for a in aliases if a in columns), None) or next((lower[a] for a in aliases if a in lower), None)
            if hit:
                found[name] = hit
    return found


def blank_null_text(x: Column) -> Column:
    """Null, and nan, none or null written as text, become ''."""
    return F.coalesce(F.when(F.lower(F.trim(x)).isin("nan", "none", "null"), "").otherwise(x), F.lit(""))


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.col(name).cast("array<string>"), "\n")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(F.col(name))
    if isinstance(kind, T.BinaryType):
        return F.decode(F.col(name), "UTF-8")
    return F.col(name).cast("string")


def whole_number(x: Column) -> Column:
    """12 and 12.0 as numbers, all else null."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(r"^\d{1,9}(?:\.0+)?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("int"))


def pr_number(ident: str = "instance_id", repo: str = "repo", number: str = "pr_number", url: str = "pr_url") -> Column:
    """From the link, else the column, else the id if the repository it encodes is the row's."""
    part = lambda i: F.regexp_extract(ident, r"^([^_]+)__([^/]+)-(\d+)$", i)
    from_id = F.when(F.lower(F.concat(part(1), F.lit("/"), part(2))) == F.lower(F.col(repo)), whole_number(part(3)))
    return F.coalesce(whole_number(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"/pull/(\d+)", 1)), whole_number(F.col(number)), from_id)


def normalise(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """(instance_id, repo, base_commit, patch, test_patch, problem_statement, created_at, pr_number, pr_url).

    Missing columns are '' or null, a missing repository is unknown/repo, an owner column is put in front of a bare name,
    arrays are joined by line ends and structures become JSON. Rows without an id are left out. Other columns are dropped.
    """
    found = resolve(df.columns, declared)
    if "instance_id" not in found:
        raise ValueError("no column with an id")
    get = lambda k: _text(df, found[k]) if k in found else F.lit(None).cast("string")
    repo = canonical_repo(get("repo"))
    if "org" in df.columns:
        repo = F.when(~repo.contains("/"), F.concat(F.lower("org"), F.lit("/"), repo)).otherwise(repo)
    base = get("base_commit")
    if "base_commit" not in found and "base" in df.columns and isinstance(df.schema["base"].dataType, T.StructType):
        base = F.col("base.sha").cast("string")
    number = F.coalesce(*[whole_number(F.col(c)) for c in PR_COLUMNS if c in df.columns], F.lit(None).cast("int"))
    url = F.coalesce(*[F.when(F.col(c).contains("/pull/"), F.col(c)) for c in URL_COLUMNS if c in df.columns and df.schema[c].dataType == T.StringType()], F.lit(None).cast("string"))
    out = df.select(
        get("instance_id").alias("instance_id"), F.coalesce(F.nullif(repo, F.lit("")), F.lit("unknown/repo")).alias("repo"), F.coalesce(base, F.lit("")).alias("base_commit"),
        *[F.coalesce(get(k), F.lit("")).alias(k) for k in ("patch", "test_patch", "problem_statement")], get("created_at").alias("created_at"), number.alias("pr_number"), url.alias("pr_url"),
    )
    return out.where("instance_id is not null and instance_id != ''")


def find_dataset(name: str, registry: dict[str, str]) -> str | None:
    """The registered key a request means: the same name whatever its case, else the longest key that the name contains."""
    wanted = name.strip().lower()
    keys = {k.lower(): k for k in registry}
    if wanted in keys:
        return keys[wanted]
    inside = [k for k in keys if k in wanted]
    return keys[max(inside, key=len)] if inside else None
