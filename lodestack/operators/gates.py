"""Independent gates: contracts of captures and Markdown outputs, checked from the text alone.

Nothing here imports a writer, so that a writer's mistake can't hide itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import compacted
from ..functions.text import col, first, has, strings, strip

# Labels and marks of a capture, and the least body.
START, END = "=== JOB POST START ===", "=== JOB POST END ==="
CAPTURE_LABELS = ["Company", "Role", "Working Location(s)", "Employment Type", "Base Salary", "Posted", "Apply URL", "Job Posting URL"]
LEAST_BODY = 700
ABSENT = "Employer did not mention"
CHOICE = r"(?i)\b(yes or no|i (understand|agree|acknowledge)|prefer not to (say|answer))\b"
STRUCTURE = ["responsib", "qualificat", "requirement", "about the role", "about the job", "what you", "who you are"]


def capture_problems(text, filename=None) -> Column:
    """Every contract that a capture breaks, in order; empty if it passes."""
    t = F.coalesce(col(text), F.lit(""))
    head, body = F.substring_index(t, START, 1), strip(F.substring_index(F.substring_index(t, START, -1), END, 1))
    at = [F.instr(t, f"\n{label}:") + F.when(t.startswith(f"{label}:"), 1).otherwise(0) for label in CAPTURE_LABELS]
    value = lambda label: F.regexp_extract(head, rf"(?m)^{label.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}:[ \t]*(.*)$", 1)
    whole = F.contains(t, F.lit(START)) & F.contains(t, F.lit(END))
    rules = []
    if filename is not None:
        rules.append((~has(filename, r"^[a-z0-9][a-z0-9-]*__[a-z0-9][a-z0-9-]*\.txt$"), "filename not canonical"))
    rules.append((~whole, "body marks missing"))
    rules += [(p == 0, f"missing label {label}") for p, label in zip(at, CAPTURE_LABELS)]
    rules += [((p > 0) & (strip(value(label)) == ""), f"blank {label}") for p, label in zip(at, CAPTURE_LABELS)]
    order = F.lit(False)
    for a, b in zip(at, at[1:]):
        order = order | ((a > 0) & (b > 0) & (b < a))
    rules += [
        (order, "labels out of order"), (has(value("Working Location(s)"), CHOICE), "choice text in a location"), (whole & (F.length(body) < LEAST_BODY), "body too short"),
        (whole & ~F.exists(strings(STRUCTURE), lambda m: F.contains(F.lower(body), m)), "body has no structure"),
        (value("Base Salary").startswith(ABSENT) & has(body, r"(?i)(salary|base pay|pay range)[^\n]{0,80}\$\s?\d{2,3}(,\d{3}|\s?k)"), "false absence of pay"),
        (has(head, r"\b(or|and|of)(?=[A-Z][a-z])"), "fused words"),
    ]
    return compacted(*rules)


def headings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, level, title) of all Markdown headings in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^(#{1,6}[ \t]+.+?)[ \t]*$"))
    one = rows.select(key, F.posexplode(found).alias("pos", "h"))
    return one.select(key, "pos", F.length(F.regexp_extract("h", r"^(#+)", 1)).alias("level"), F.regexp_replace("h", r"^#+[ \t]+", "").alias("title"))


def output_problems(rows: DataFrame, required: list[str], key: str, least_skills: int = 12, text: str = "text") -> DataFrame:
    """(key, problem): required headings that an output lacks or has out of order, and too few skills."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(required)), "place int, title string").withColumn("_k", F.lower("title"))
    h = headings(rows, key, text).withColumn("_k", F.lower(F.trim("title"))).groupBy(key, "_k").agg(F.min("pos").alias("pos"))
    pairs = rows.select(key, F.explode(F.array(*[F.lit(r.lower()) for r in required])).alias("_k"))
    missing = pairs.join(h, [key, "_k"], "left_anti").select(key, F.concat(F.lit("missing "), "_k").alias("problem"))
    placed = h.join(F.broadcast(wanted), "_k")  # a list that someone writes by hand
    before = F.lag("pos").over(Window.partitionBy(key).orderBy("place"))
    late = placed.withColumn("_b", before).where("_b > pos").select(key, F.concat(F.lit("out of order "), "_k").alias("problem"))
    skills = F.size(F.filter(F.split(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?ims)^#+[ \t]+skills[ \t]*$(.*?)(?=^#|\z)", 1), r"[,;·\n]"), lambda s: strip(F.regexp_replace(s, r"^\s*[-*]\s*", "")) != ""))
    few = rows.where((skills > 0) & (skills < least_skills)).select(key, F.lit("too few skills").alias("problem"))
    return missing.unionByName(late).unionByName(few)


def anchor_checks(results: DataFrame, anchors: DataFrame, ledger: str, score: str) -> DataFrame:
    """(job_key, status) of results that an anchor is known for."""
    from ..functions.scores import anchor_status

    joined = results.join(anchors.withColumnRenamed("job_key", "_k"), F.col("job_key") == F.col("_k"))
    return joined.select("job_key", anchor_status(ledger, score, "anchor").alias("status"))


def ledger_of_bases(index: DataFrame) -> DataFrame:
    """(pos, title, registered) of every base of an index, newest first and undated last, in their order among equals."""
    title, body = F.col("s.title"), F.col("s.body")
    day = F.date_format(F.try_to_date(F.coalesce(first(body, r"(\d{4}-\d{2}-\d{2})"), first(title, r"(\d{4}-\d{2}-\d{2})")), "yyyy-MM-dd"), "yyyy-MM-dd")
    from ..sources.files import sections

    rows = index.select(F.posexplode(sections(F.col("text"), 3)).alias("pos", "s")).select("pos", title.alias("title"), day.alias("registered"))
    return rows.orderBy(F.desc(F.coalesce("registered", F.lit(""))), "pos")


def question_classes(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """questions (file, label) with their class from the manifest (file, label, class), else by their wording."""
    from ..functions.questions import standard, thoughtful

    known = manifest.select(F.col("file").alias("_f"), F.lower(strip("label")).alias("_l"), F.col("class").alias("_c")).dropDuplicates(["_f", "_l"])
    joined = questions.join(known, (F.col("file") == F.col("_f")) & (F.lower(strip("label")) == F.col("_l")), "left")
    q = F.struct(F.col("label"), F.lit("").alias("type"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("options"))
    by_words = F.when(standard(q), "standard").when(thoughtful("label"), "substantive").otherwise("logistical")
    return joined.select("file", "label", F.coalesce("_c", by_words).alias("class"))
