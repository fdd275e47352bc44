"""Trained filters: a linear classifier over word n-grams as a stand-in for models that need downloads; labelled-language filter."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.labels import normal_label

FEATURES = 1 << 14


def train(df: DataFrame, rounds: int = 20) -> PipelineModel:
    """Model from (text, label) with labels 0 and 1: hashed words and word pairs, logistic regression."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"\s+", toLowercase=True),
        NGram(n=2, inputCol="_w", outputCol="_p"),
        HashingTF(numFeatures=FEATURES, inputCol="_w", outputCol="_f1"),
        HashingTF(numFeatures=FEATURES, inputCol="_p", outputCol="_f2"),
    ]
    from pyspark.ml.feature import VectorAssembler

    stages += [VectorAssembler(inputCols=["_f1", "_f2"], outputCol="_f"), LogisticRegression(featuresCol="_f", labelCol="label", maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=stages).fit(df.select(T.text(F.col("text")).alias("text"), F.col("label").cast("double").alias("label")))


def code_filter(df: DataFrame, model: PipelineModel, least: float = 0.5) -> DataFrame:
    """(doc_id, code_score, status): first lines that the model takes for code with a score above `least` are classifier_code; blank ones are kept with 0."""
    lines = df.select("doc_id", T.first_line(T.text(F.col("text"))).alias("text"))
    s = model.transform(lines).select("doc_id", "text", vector_to_array("probability")[1].alias("p"))
    score = F.when(F.col("text") == "", F.lit(0.0)).otherwise(F.col("p"))
    return s.select("doc_id", F.round(score, 6).alias("code_score"), F.when(score > least, "classifier_code").otherwise("kept").alias("status"))


def education_filter(df: DataFrame, model: PipelineModel, least: int = 2) -> DataFrame:
    """(doc_id, education, status): the model's probability as a whole score from 0 to 5; below `least` it is low_educational, blank texts have 0."""
    s = model.transform(df.select("doc_id", T.text(F.col("text")).alias("text"))).select("doc_id", "text", vector_to_array("probability")[1].alias("p"))
    score = F.when(T.strip(F.col("text")) == "", F.lit(0)).otherwise(F.round(F.col("p") * 5).cast("int"))
    return s.select("doc_id", score.alias("education"), F.when(score < least, "low_educational").otherwise("kept").alias("status"))


def labelled_language(labels: DataFrame, language: str = "en", least: float = 0.8) -> DataFrame:
    """(row_id, lang, conf) of the records whose latest label is the language, in any notation, with at least `least` confidence; percents are read as shares."""
    last = labels.groupBy("row_id").agg(F.max_by(F.struct("lang", "lang_conf"), F.struct("detected_at", "lang_conf", "lang")).alias("l")).select("row_id", "l.*")
    conf = F.when(F.col("lang_conf") > 1, F.col("lang_conf") / 100).otherwise(F.col("lang_conf"))
    s = last.select("row_id", normal_label(F.col("lang")).alias("lang"), F.round(conf, 6).alias("conf"))
    return s.where((F.col("lang") == language) & (F.col("conf") >= least))


def annotation_score(answer: Column) -> Column:
    """Score 1 to 5 that an annotator's answer begins with; null if it doesn't."""
    return F.nullif(F.regexp_extract(T.strip(answer), "^([1-5])", 1), F.lit("")).cast("int")


def labelled_lines(df: DataFrame, label: Column, *columns: str) -> DataFrame:
    """(columns, line): training lines `__label__<label> <first line>`; blank first lines and null labels are left out."""
    s = df.select(*columns, label.cast("string").alias("_label"), T.first_line(T.text(F.col("text"))).alias("_line"))
    return s.where("_label is not null and _line <> ''").select(*columns, F.concat(F.lit("__label__"), F.col("_label"), F.lit(" "), F.col("_line")).alias("line"))


def annotated_lines(df: DataFrame) -> DataFrame:
    """Training lines `__label__<score> <first line>` of (text, answer); answers without a score and blank lines are left out."""
    return labelled_lines(df, annotation_score(F.col("answer")))
