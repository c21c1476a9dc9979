"""Language-model re-ranking as tables in / tables out (FN-30, FN-31, FN-33, RNK-4).

The remote call itself is not part of this library: ``prompts`` builds one
prompt row per source column, a user-supplied batch function (for example a
``pandas_udf``) turns prompts into response text, and ``parse_response`` /
``merge_judgements`` fold the answers back into the match table. Parsing is a
Catalyst expression (``regexp_extract`` + ``from_json``); a response that does
not parse keeps the previous scores of that source column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: judge instructions (system message and prompt frame) as used by
# the matching system this library reproduces.
JUDGE_SYSTEM = "You are an AI trained to perform schema matching by providing column similarity scores."
JUDGE_HEAD = (
    "Given a candidate column and a list of target columns, judge the similarity between the candidate and each target column. "
    "Return a JSON array of objects, each with 'column' (the target column name) and 'score' (a float between 0 and 1, two decimals, 1 is most similar). "
    "Do NOT provide any other output text or explanation. Only provide the JSON array.\n"
    "Example:\n"
    "Candidate Column: Column: EmployeeID, Sample values: [100, 101, 102]\n"
    "Target Schemas:\n"
    "Column: WorkerID, Sample values: [100, 101, 102]\n"
    "Column: EmpCode, Sample values: [001, 002, 003]\n"
    "Column: StaffName, Sample values: ['Alice', 'Bob', 'Charlie']\n"
    'Response: [\n  {"column": "WorkerID", "score": 0.95},\n  {"column": "EmpCode", "score": 0.30},\n  {"column": "StaffName", "score": 0.05}\n]\n\n'
    "Candidate Column: "
)
JUDGE_MID = "\n\nTarget Schemas:\n"
JUDGE_TAIL = "\n\nResponse: "

# FIXED VALUES: augmentation request texts (with and without sample values).
AUG_WITH_VALUES = (
    "Given the table column '{name}' with values {values}, "
    "generate three alternative column names that adhere to typical database naming conventions such as underscores and abbreviations. "
    "Additionally, provide distinct, technically correct synonyms, variants, or abbreviations for the listed values "
    "For columns with numerical or datetime data, generate random numbers or dates appropriate to the column's semantic meaning. "
    "Ensure that each set does not exceed 15 values. "
    "Format your output as follows: "
    "alternative_name_1, value1, value2, value3, ...; alternative_name_2, value1, value2, value3, ...; alternative_name_3, value1, value2, value3, ... "
    "Ensure your response excludes additional information and quotations."
)
AUG_NO_VALUES = (
    "Given the table column '{name}', generate three alternative column names that adhere to typical database naming conventions such as underscores and abbreviations. "
    "Additionally, suggest distinct, technically accurate values appropriate for the data type of the column. "
    "Ensure that each set does not exceed 15 values. "
    "Format your output as follows: "
    "alternative_name_1, value1, value2, value3, ...; alternative_name_2, value1, value2, value3, ...; alternative_name_3, value1, value2, value3, ... "
    "Ensure your response excludes additional information and quotations."
)

RESPONSE_SCHEMA = "array<map<string,string>>"


def column_line(name: Column, samples: Column) -> Column:
    return F.concat(F.lit("Column: "), name, F.lit(", Sample values: ["), F.array_join(F.coalesce(samples, F.array().cast("array<string>")), ","), F.lit("]"))


def prompts(cands: DataFrame, samples: DataFrame) -> DataFrame:
    """One prompt per source column (FN-30).

    ``cands``: ``(src_table, src_col, tgt_table, tgt_col, rank)``; ``samples``:
    ``(table_id, col_name, samples)`` drawn from the raw tables.
    Targets are listed in candidate order.
    """
    s = samples.select(F.col("table_id").alias("src_table"), F.col("col_name").alias("src_col"), F.col("samples").alias("s_samples"))
    t = samples.select(F.col("table_id").alias("tgt_table"), F.col("col_name").alias("tgt_col"), F.col("samples").alias("t_samples"))
    c = cands.join(t, ["tgt_table", "tgt_col"], "left")
    per_src = c.groupBy("src_table", "src_col", "tgt_table").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", column_line(F.col("tgt_col"), F.col("t_samples")).alias("line")))), lambda x: x["line"]),
            "\n",
        ).alias("targets")
    )
    j = per_src.join(s, ["src_table", "src_col"], "left")
    cand = column_line(F.col("src_col"), F.col("s_samples"))
    return j.select("src_table", "src_col", "tgt_table", F.concat(F.lit(JUDGE_HEAD), cand, F.lit(JUDGE_MID), F.col("targets"), F.lit(JUDGE_TAIL)).alias("prompt"))


def parse_response(text: Column) -> Column:
    """``[{column, score}]`` found in the text, or null when nothing parses (FN-31).

    Tolerated are text around the list, trailing commas and a list that is cut
    off after an entry. A missing score is 0; a score that is null or no number
    makes the whole answer unreadable.
    """
    whole = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    cut = F.regexp_extract(text, r"(?s)\[.*\}", 0)
    js = F.when(whole != "", whole).when(cut != "", F.concat(cut, F.lit("]")))
    arr = F.from_json(F.regexp_replace(js, r",(\s*[\]}])", "$1"), RESPONSE_SCHEMA)

    def number(e):
        v = F.try_element_at(e, F.lit("score"))
        value = F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(F.trim(v).try_cast("double"))
        return F.when(F.map_contains_key(e, F.lit("score")), value).otherwise(F.lit(0.0))

    entries = F.transform(arr, lambda e: F.struct(F.try_element_at(e, F.lit("column")).alias("column"), number(e).alias("score")))
    readable = F.forall(arr, lambda e: e.isNotNull()) & F.forall(entries, lambda e: e["score"].isNotNull())
    return F.when(readable, entries)


def merge_judgements(matches: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace all scores of a source column by the parsed judgement; keep them when it does not parse (RNK-4).

    ``matches``: ``(src_table, src_col, tgt_table, tgt_col, score)``;
    ``responses``: ``(src_table, src_col, tgt_table, response)``.
    """
    parsed = responses.select("src_table", "src_col", "tgt_table", parse_response(F.col("response")).alias("_p"))
    ok = parsed.filter(F.col("_p").isNotNull())
    new = ok.select("src_table", "src_col", "tgt_table", F.explode("_p").alias("_e")).select(
        "src_table", "src_col", "tgt_table", F.col("_e.column").alias("tgt_col"), F.col("_e.score").alias("score")
    )
    kept = matches.join(ok.select("src_table", "src_col", "tgt_table"), ["src_table", "src_col", "tgt_table"], "left_anti")
    out = kept.select("src_table", "src_col", "tgt_table", "tgt_col", "score").unionByName(new)
    w = Window.partitionBy("src_table", "src_col", "tgt_table").orderBy(F.col("score").desc(), F.col("tgt_col"))
    return out.withColumn("rank", F.row_number().over(w))


def python_list_text(values: Column, quoted: Column) -> Column:
    """Render an array as Python prints a list: ``['a', 'b']`` for text, ``[1, 2]`` for numbers."""
    items = F.transform(values, lambda v: F.when(quoted, F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def augmentation_prompts(lists: DataFrame) -> DataFrame:
    """Augmentation request per column (FN-33). ``lists``: ``(col_name, values, is_text)``."""
    head_with = F.concat(F.lit("Given the table column '"), F.col("col_name"), F.lit("' with values "), python_list_text(F.col("values"), F.col("is_text")))
    rest_with = AUG_WITH_VALUES.split("{values}", 1)[1]
    head_none = F.concat(F.lit("Given the table column '"), F.col("col_name"), F.lit("'"))
    rest_none = AUG_NO_VALUES.split("'{name}'", 1)[1]
    text = F.when(F.size("values") > 0, F.concat(head_with, F.lit(rest_with))).otherwise(F.concat(head_none, F.lit(rest_none)))
    return lists.select("col_name", text.alias("prompt"))
