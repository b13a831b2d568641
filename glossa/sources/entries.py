"""Dictionary entries as text: parsing lines and version blocks, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import HANZI as IDEOGRAPH
from glossa.functions.text import let

# Status words of version lines.
STATUS = {"New": 0, "Verif": 1, "Flagged": 2}


def syllables(text: Column) -> Column:
    """Syllables (text, tone) of a pinyin field: tone 1 to 4, 0 for 5, -1 for what isn't a syllable with a tone."""
    def one(p):
        toned = (F.length(p) > 1) & p.rlike("[1-5]$")
        body = F.substring(p, F.lit(1), F.length(p) - 1)
        for a, b in (("u:", "v"), ("U:", "V"), ("ü", "v"), ("Ü", "V")):
            body = F.replace(body, F.lit(a), F.lit(b))
        tone = F.substring(p, -1, 1).try_cast("int")
        return F.when(toned, F.struct(body.alias("text"), F.when(tone == 5, 0).otherwise(tone).alias("tone"))).otherwise(F.struct(p.alias("text"), F.lit(-1).alias("tone")))

    return F.transform(F.split(text, " "), one)


def sense(text: Column) -> Column:
    """Domain, equivalent and note of a sense: the equivalent runs from the first to the last character outside parentheses."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc, c):
        content = ~c.rlike(r"^[\s()]$") & (acc["depth"] == 0) & (c != "")
        return F.struct(
            (acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (acc["i"] + F.length(c)).alias("i"),
            F.when(content & (acc["first"] < 0), acc["i"]).otherwise(acc["first"]).alias("first"), F.when(content, acc["i"]).otherwise(acc["last"]).alias("last"),
        )

    def cut(x):
        t = x["t"]
        at = x["at"]
        return F.when(at["first"] < 0, F.struct(t.alias("domain"), F.lit("").alias("equiv"), F.lit("").alias("note"))).otherwise(
            F.struct(F.substring(t, F.lit(1), at["first"]).alias("domain"), F.substring(t, at["first"] + 1, at["last"] - at["first"] + 1).alias("equiv"), F.substring(t, at["last"] + 2, F.length(t)).alias("note"))
        )

    return let(F.struct(text.alias("t"), F.aggregate(F.split(text, ""), start, step).alias("at")), cut)


def character_map(head: Column, sylls: Column) -> Column:
    """For each character of a headword the place of its syllable, -1 for other characters; null where counts differ."""
    chars = F.filter(F.split(head, ""), lambda c: c != "")
    toned = F.filter(F.transform(sylls, lambda s, i: F.when(s["tone"] >= 0, i)), lambda i: i.isNotNull())
    seen = lambda cs, i: F.size(F.filter(F.slice(cs, 1, i), lambda c: c.rlike(IDEOGRAPH)))
    mapped = let(chars, lambda cs: let(toned, lambda ts: F.when(F.size(F.filter(cs, lambda c: c.rlike(IDEOGRAPH))) == F.size(ts), F.transform(cs, lambda c, i: F.when(c.rlike(IDEOGRAPH), F.get(ts, seen(cs, i))).otherwise(-1)))))
    return mapped


def parse_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with entry (trad, simp, pinyin, senses, hz2py) and, where it is null, error. Comments and blanks are dropped."""
    t = F.col(text)
    kept = lines.where(~t.rlike(r"^\s*(#|$)"))
    part = lambda i: F.regexp_extract(t, r"^([^ ]+) ([^ ]+) \[([^\]]*)\] (/.*)$", i)
    cut = kept.select("*", part(1).alias("__trad"), part(2).alias("__simp"), part(3).alias("__py"), part(4).alias("__body")).withColumn("__sylls", syllables(F.col("__py"))).withColumn("__map", character_map(F.col("__trad"), F.col("__sylls")))
    bodies = F.transform(F.split(F.expr("substring(__body, 2, length(__body) - 2)"), "/"), lambda s: sense(F.replace(s, F.lit("\\"), F.lit("/"))))
    error = (
        F.when(t.rlike(r"[\x{10000}-\x{10FFFF}]"), "character beyond the basic plane")
        .when(F.col("__trad") == "", "header")
        .when(F.length("__trad") != F.length("__simp"), "lengths of traditional and simplified differ")
        .when(F.col("__map").isNull(), "characters and syllables don't match")
        .when(~F.endswith("__body", F.lit("/")), "no slash at the end")
        .when(F.length("__body") < 3, "empty body")
    )
    entry = F.struct(F.col("__trad").alias("trad"), F.col("__simp").alias("simp"), F.col("__sylls").alias("pinyin"), bodies.alias("senses"), F.col("__map").alias("hz2py"))
    return cut.withColumn("error", error).withColumn("entry", F.when(F.col("error").isNull(), entry)).drop("__trad", "__simp", "__py", "__body", "__sylls", "__map")


def written(entry: Column) -> Column:
    """The line of an entry; slashes inside senses become backslashes."""
    sylls = F.array_join(F.transform(entry["pinyin"], lambda s: F.concat(s["text"], F.when(s["tone"] < 0, "").when(s["tone"] == 0, "5").otherwise(s["tone"].cast("string")))), " ")
    body = F.array_join(F.transform(entry["senses"], lambda s: F.replace(F.concat(s["domain"], s["equiv"], s["note"]), F.lit("/"), F.lit("\\"))), "/")
    return F.concat(entry["trad"], F.lit(" "), entry["simp"], F.lit(" ["), sylls, F.lit("] /"), body, F.lit("/"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block: one row for each version block of the files; Spark cuts them at the block mark, so files can be split."""
    return spark.read.option("lineSep", "# ID-").text(path).select(F.col("value").alias("block")).where(F.col("block").rlike(r"^\S{7}\n"))


def versions(blocks: DataFrame) -> DataFrame:
    """code, version (from 0), time, user, status, bulk_ref, comment, line of each version; a line left out is the one before."""
    rows = F.filter(F.split("block", "\n"), lambda x: x != "")
    cut = blocks.select(F.substring("block", 1, 7).alias("code"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"))
    each = cut.select("code", F.posexplode("rows").alias("at", "row"))
    each = each.select("code", "at", F.startswith("row", F.lit("# Ver")).alias("is_version"), F.regexp_replace("row", "^# (?!Ver )", "").alias("row"))
    from pyspark.sql import Window

    line = Window.partitionBy("code").orderBy("at")
    each = each.withColumn("line", F.when(F.lead("is_version", 1, True).over(line) == F.lit(False), F.lead("row").over(line)))
    each = each.where("is_version").withColumn("line", F.last("line", ignorenulls=True).over(line)).withColumn("version", F.row_number().over(line) - 1)
    part = lambda i: F.regexp_extract("row", r"(?s)^# Ver ([^ ]+) ([^ ]+) Stat-([^ ]+) (\d*)>(.*)$", i)
    mark = "\ue000"
    comment = F.replace(F.replace(F.replace(part(5), F.lit("\\\\"), F.lit(mark)), F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    bulk = F.when((part(4) == "") | (part(4).try_cast("int") <= 0), -1).otherwise(part(4).try_cast("int"))
    return each.select("code", "version", F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("time"), part(2).alias("user"), F.try_element_at(status, part(3)).alias("status"), bulk.alias("bulk_ref"), comment.alias("comment"), "line")


def version_line(time: Column, user: Column, status: Column, bulk_ref: Column, comment: Column) -> Column:
    """The line of a version, without its end; a comment's line feeds and backslashes are escaped."""
    names = F.array(*(F.lit(k) for k in STATUS))
    ref = F.when(bulk_ref > 0, F.lpad(bulk_ref.cast("string"), 3, "0")).otherwise("000")
    note = F.replace(F.replace(comment, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("# Ver "), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), user, F.lit(" Stat-"), F.get(names, status), F.lit(" "), ref, F.lit(">"), note)


def block_text(history: DataFrame) -> DataFrame:
    """code, block: the block of each entry from its versions; lines equal to the version before are left out."""
    row = F.struct("version", "time", "user", "status", "bulk_ref", "comment", "line")
    grouped = history.groupBy("code").agg(F.array_sort(F.collect_list(row)).alias("v"))

    def one(v, i):
        head = F.concat(version_line(*(v[c] for c in ("time", "user", "status", "bulk_ref", "comment"))), F.lit("\n"))
        last = i == F.size("v") - 1
        same = F.coalesce(F.get("v", i - 1)["line"] == v["line"], F.lit(False))
        return F.concat(head, F.when(last, F.concat(v["line"], F.lit("\n"))).when(same, "").otherwise(F.concat(F.lit("# "), v["line"], F.lit("\n"))))

    return grouped.select("code", F.concat(F.lit("# ID-"), "code", F.lit("\n"), F.array_join(F.transform("v", one), "")).alias("block"))
