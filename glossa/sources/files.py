"""Text sources: lines in order, tab-separated tables, word vectors, character data, address ranges, catalogs, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators.tokens import ranked, running


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), text, in the order of the files and of the lines in them.

    Lines are numbered inside each block that a task reads; running counts of the blocks make the numbers whole. Rows and
    counts come from two scans of one plan, which are cut alike; a caller that reads the lines in several jobs saves them first.
    """
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("at"), F.monotonically_increasing_id().alias("row"))
    counts = raw.groupBy("at").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("at").orderBy("row")) - 1
    return raw.withColumn("local", local).join(counts.select("at", before.alias("before")), "at").select((F.col("local") + F.col("before")).alias("line"), "text")


def merged_lines(first: DataFrame, second: DataFrame, mark: str = "@TOSIMP@") -> DataFrame:
    """Lines of which those that are the mark are replaced, in turn, by the lines of a second table."""
    marked = ranked(first.where(F.col("text") == mark).select("line"), "line").select("line", (F.col("rank") - 1).alias("ordinal"))
    put = marked.join(second.select(F.col("line").alias("ordinal"), F.col("text").alias("new")), "ordinal", "left").select("line", "new")
    return first.join(put, "line", "left").select("line", F.coalesce("new", "text").alias("text"))


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word, freq; lines without exactly two fields, or whose second isn't a number, are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("word"), f[1].try_cast("long").alias("freq")).where("freq IS NOT NULL")


def ranked_frequencies(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """rank, freq, word of a ranked list, from a least frequency on."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) == 3).select(f[0].try_cast("long").alias("rank"), f[1].try_cast("long").alias("freq"), f[2].alias("word")).where(F.col("freq") >= least)


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vec, chinese of the word2vec text format; the header line, which has two fields, is skipped."""
    f = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(f) > 2)
    vec = F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.try_cast("float"))
    return rows.select(F.regexp_replace(f[0], "^(zh|hu)_", "").alias("word"), F.filter(vec, lambda x: x.isNotNull()).alias("vec"), (F.startswith(f[0], F.lit("zh_")) | (F.ascii(f[0]) >= 0x4E00)).alias("chinese"))


def readings(spark: SparkSession, path: str, fields: tuple[str, ...] = ("kHanyuPinlu", "kHanyuPinyin", "kMandarin", "kXHC1983")) -> DataFrame:
    """hanzi and an array of readings for each field, of character data lines `U+XXXX field value`; basic plane only."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) == 3).select(F.conv(F.substring(f[0], 3, 6), 16, 10).cast("long").alias("cp"), f[1].alias("field"), F.split(f[2], " ").alias("value"))
    rows = rows.where((F.col("cp") < 0x10000) & F.col("field").isin(*fields)).select(F.decode(F.unhex(F.lpad(F.hex("cp"), 4, "0")), "UTF-16BE").alias("hanzi"), "field", "value")
    return rows.groupBy("hanzi").pivot("field", list(fields)).agg(F.first("value"))


def address_ranges(spark: SparkSession, path: str) -> DataFrame:
    """lo, hi, label of quoted CSV: fields 0, 1 and 5."""
    raw = spark.read.csv(path, quote='"', comment="#")
    return raw.select(F.col("_c0").try_cast("long").alias("lo"), F.col("_c1").try_cast("long").alias("hi"), F.col("_c4" if len(raw.columns) < 6 else "_c5").alias("label")).where("lo IS NOT NULL AND hi IS NOT NULL")


def catalog(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, key, value of a JSON catalog of groups of strings; keys are group.name."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    each = raw.select(F.explode("m").alias("group", "names")).select("group", F.explode("names").alias("name", "value"))
    return each.select(F.lit(lang).alias("lang"), F.concat_ws(".", "group", "name").alias("key"), "value")


def translated(keys: DataFrame, strings: DataFrame, lang: str) -> DataFrame:
    """keys with the string of a language, else English, else the key itself."""
    own, english = (strings.where(F.col("lang") == x).select("key", F.col("value").alias(f"v_{i}")) for i, x in enumerate((lang, "en")))
    return keys.join(own, "key", "left").join(english, "key", "left").select("key", F.coalesce("v_0", "v_1", "key").alias("value"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """lang, rel, mutation, title, body of a folder of pages with metadata comments."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    field = lambda k: F.nullif(F.regexp_extract("value", rf"<!--\s*{k}:\s*(.*?)\s*-->", 1), F.lit(""))
    return raw.select(F.coalesce(field("lang"), F.lit("*")).alias("lang"), F.coalesce(field("rel"), "name").alias("rel"), field("mutation").alias("mutation"), field("title").alias("title"), F.trim(F.regexp_replace("value", r"(?s)<!--.*?-->", "")).alias("body"))


def page_for(found: DataFrame, lang: str, rel: str) -> DataFrame:
    """The page of a path in a language, else for any language, else in English."""
    order = F.when(F.col("lang") == lang, 0).when(F.col("lang") == "*", 1).when(F.col("lang") == "en", 2)
    return found.where((F.col("rel") == rel) & order.isNotNull()).orderBy(order).limit(1)


def write_lines(df: DataFrame, path: str, *columns: str, gzip: bool = False) -> None:
    """Tab-separated lines without quotes, replacing what is at the path."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    df.select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip" if gzip else "none")


def zipped_heads(simp: DataFrame, trad: DataFrame) -> DataFrame:
    """line, text: entry lines made from two lists of headwords line by line, up to the end of the shorter one."""
    both = simp.select("line", F.col("text").alias("s")).join(trad.select("line", F.col("text").alias("t")), "line")
    return both.select("line", F.concat("t", F.lit(" "), "s", F.lit(" [pin yin] /sense/")).alias("text"))


def escaped_heads(lines: DataFrame) -> DataFrame:
    """line, text: the second field of tab-separated lines after the header, with {[hex]} as the character it names."""
    head = F.get(F.split("text", "\t"), F.lit(1))
    parts = F.split(head, r"(?=\{\[[0-9A-Fa-f]{4}\]\})|(?<=\{\[[0-9A-Fa-f]{4}\]\})")
    one = lambda x: F.when(x.rlike(r"^\{\[[0-9A-Fa-f]{4}\]\}$"), F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")).otherwise(x)
    return lines.where("line > 0").select("line", F.array_join(F.transform(parts, one), "").alias("text"))


def analysis_groups(lines: DataFrame) -> DataFrame:
    """surf, analyses of groups of lines `surface TAB analysis`, which blank lines part."""
    grouped = running(lines, "line", F.col("text") == "", "group").where("text <> ''")
    f = F.split("text", "\t")
    each = grouped.select("group", "line", f[0].alias("surf"), F.get(f, F.lit(1)).alias("analysis"))
    return each.groupBy("group").agg(F.min_by("surf", "line").alias("surf"), F.transform(F.array_sort(F.collect_list(F.struct("line", "analysis"))), lambda x: x["analysis"]).alias("analyses")).drop("group")


def vocabulary(groups: DataFrame) -> DataFrame:
    """word, is_word: lower-case surface forms; one whose first analysis ends with a question mark is no word."""
    return groups.select(F.lower("surf").alias("word"), (~F.endswith(F.get("analyses", F.lit(0)), F.lit("?"))).alias("is_word")).groupBy("word").agg(F.max("is_word").alias("is_word"))


def variants(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """hanzi, field, variant of the two variant fields, of characters that known (hanzi) has readings for."""
    f = F.split("value", "\t")
    char = lambda c: F.decode(F.unhex(F.lpad(F.substring(c, 3, 6), 4, "0")), "UTF-16BE")
    rows = spark.read.text(path).where(F.size(f) == 3).select(f[0].alias("c"), f[1].alias("field"), F.explode(F.split(f[2], " ")).alias("v"))
    rows = rows.where(F.col("field").isin("kTraditionalVariant", "kSimplifiedVariant") & (F.length("c") == 6) & (F.length("v") == 6))
    return rows.select(char(F.col("c")).alias("hanzi"), "field", char(F.col("v")).alias("variant")).join(known.select("hanzi").distinct(), "hanzi", "left_semi")


def kept_vectors(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """Vectors of the words that a vocabulary has."""
    return vectors.join(words.select("word").distinct(), "word", "left_semi")


def rank_list(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """word, rank (from 0) of a CSV list in its own order."""
    lines = numbered_lines(spark, path)
    return lines.select(F.get(F.split("text", ","), F.lit(column)).alias("word"), F.col("line").alias("rank")).groupBy("word").agg(F.min("rank").alias("rank"))


def heads_of(lines: DataFrame) -> DataFrame:
    """simp, entries: entry lines by their second field, joined with ' @@ ' in line order."""
    kept = lines.where(~F.col("text").rlike(r"^\s*(#|$)"))
    each = kept.groupBy(F.get(F.split("text", " "), F.lit(1)).alias("simp")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("e"))
    return each.select("simp", F.array_join(F.transform("e", lambda x: x["text"]), " @@ ").alias("entries"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """token, user_id, expires, user_name, score, perms of persisted sessions; expiry is in ticks of 100 ns since year 1."""
    f = F.split("value", "\t")
    seconds = (f[2].try_cast("decimal(20,0)") / 10_000_000).cast("long") - 62_135_596_800
    return spark.read.text(path).where(F.size(f) == 6).select(f[0].alias("token"), f[1].try_cast("int").alias("user_id"), F.timestamp_seconds(seconds).alias("expires"), f[3].alias("user_name"), f[4].try_cast("int").alias("score"), f[5].try_cast("int").alias("perms"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """name, params (name and kind), sql of a catalog of statements between `# Script name` and `# End`."""
    raw = spark.read.option("lineSep", "# Script ").text(path).where(F.contains("value", F.lit("# End")))
    body = F.substring_index("value", "# End", 1)
    params = F.regexp_extract_all(body, F.lit(r"# @(\w+)[ \t]+\w+"), 1)
    kinds = F.regexp_extract_all(body, F.lit(r"# @\w+[ \t]+(\w+)"), 1)
    sql = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n", ""), r"(?m)^# .*$", ""), r"\s+", " "))
    return raw.select(F.trim(F.regexp_extract("value", r"^([^\s]+)", 1)).alias("name"), F.arrays_zip(params.alias("name"), kinds.alias("kind")).alias("params"), F.regexp_replace(sql, r"@(\w+)", ":$1").alias("sql"))
