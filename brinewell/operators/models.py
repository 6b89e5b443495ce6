"""Model-backed steps: a model is any callable from a list of prompts to a list of answers.

It runs in Arrow batches inside executors.  Deterministic stand-ins serve tests
and queries; a client for a real service is passed the same way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import expected_count, is_yes, non_empty_lines, render, stable_id, strip_list_marks
from ..runtime import cut_lineage

Model = Callable[[list[str]], list[str]]

TEXT, ASKED = "Text:\n", "\n\nQuestions:\n"
QUESTION_PROMPT = "Write {n} questions that the text answers, one per line.\n\n" + TEXT + "{text}"
CHECK_PROMPT = "Does the text answer each question? Say yes or no, one line for each.\n\n" + TEXT + "{text}" + ASKED + "{questions}"
ANSWER_PROMPT = "Answer from the text only.\n\n" + TEXT + "{context}" + ASKED + "{question}"
# The intents, and the one for all others.
SUMMARY_PROMPTS = {
    "현상": "Summarise what happens, where and when, with figures.\n\n" + TEXT + "{text}",
    "영향": "Summarise the harm to people or animals, with figures.\n\n" + TEXT + "{text}",
    "대응": "Summarise who responds and how.\n\n" + TEXT + "{text}",
}
OTHER_INTENT = "기타"
OTHER_PROMPT = "Summarise the text.\n\n" + TEXT + "{text}"


def ask(prompt: Column, model: Model) -> Column:
    """The model's answer to each prompt; null prompts have null answers."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        have = [p for p in s if p is not None]
        got = iter(model(have)) if have else iter(())
        return pd.Series([None if p is None else next(got) for p in s], dtype=object)

    return run(prompt)


_ENDS = re.compile(r"[.!?。！？।\n]+")


def _sentences(text: str) -> list[str]:
    return [x.strip() for x in _ENDS.split(text) if x.strip()]


def _taken_apart(prompt: str) -> tuple[str, str, str]:
    """Instruction, text and questions of a prompt."""
    head, _, rest = prompt.partition(TEXT)
    text, _, asked = rest.rpartition(ASKED) if ASKED in rest else (rest, "", "")
    return head, text, asked


def question_stub(prompts: list[str]) -> list[str]:
    """One numbered line per sentence of the text, up to the number asked for."""
    out = []
    for p in prompts:
        head, text, _ = _taken_apart(p)
        n = int((re.search(r"\d+", head) or [0])[0])
        out.append("\n".join(f"{i}. {x}?" for i, x in enumerate(_sentences(text)[:n], 1)))
    return out


def check_stub(prompts: list[str]) -> list[str]:
    """Yes, a line for each question, if its words stand in the text."""
    out = []
    for p in prompts:
        _, text, asked = _taken_apart(p)
        out.append("\n".join("yes" if q.strip(" ?？") and q.strip(" ?？") in text else "no" for q in asked.split("\n")))
    return out


def extract_stub(prompts: list[str]) -> list[str]:
    """The sentence of the text that holds most words of the question; without a question, most of the text's frequent words. Ties go to the first."""
    out = []
    for p in prompts:
        _, text, asked = _taken_apart(p)
        parts = _sentences(text)
        words = [re.findall(r"\w+", x.lower()) for x in parts]
        weight = Counter(re.findall(r"\w+", asked.lower())) if asked else Counter(w for x in words for w in x)
        score = [sum(weight[w] for w in set(x)) / (1 if asked else len(set(x)) ** 0.5) if x else 0.0 for x in words]
        out.append(parts[score.index(max(score))] if parts else "")
    return out


def sentence_type(text: Column) -> Column:
    """Stand-in for the classifier: question or narrative by its closing mark."""
    return F.when(text.rlike(r"[?？]\s*$"), "question").otherwise("narrative")


def intent(text: Column) -> Column:
    """First label that the text names, else the other label."""
    out = None
    for k in SUMMARY_PROMPTS:
        out = F.when(text.contains(k), k) if out is None else out.when(text.contains(k), k)
    return out.otherwise(OTHER_INTENT)


def keyword_terms(docs: DataFrame, doc_id: str, tokens: Column, n: int = 5) -> DataFrame:
    """(doc_id, keywords): the ``n`` terms of each document of highest tf-idf, in order, joined by commas; ties by the term.

    Counts are map-side aggregates over all documents; what is gathered is one
    document's terms.
    """
    t = docs.select(F.col(doc_id).alias("_d"), F.explode(tokens).alias("_t")).where("_t <> ''")
    tf = t.groupBy("_d", "_t").agg(F.count(F.lit(1)).alias("_tf"))
    df = tf.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    total = docs.agg(F.count(F.lit(1)).alias("_n"))
    scored = tf.join(df, "_t").join(F.broadcast(total)).withColumn("_s", F.round(F.col("_tf") * F.ln(F.col("_n") / F.col("_df")), 9))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("_d").orderBy(F.col("_s").desc(), "_t"))).where(F.col("_r") <= n)
    return best.groupBy("_d").agg(F.sort_array(F.collect_list(F.struct("_r", "_t"))).alias("_k")).select(F.col("_d").alias(doc_id), F.array_join(F.transform("_k", lambda k: k["_t"]), ",").alias("keywords"))


def metadata(df: DataFrame, text: str) -> DataFrame:
    """The question carried through as it is, with its sentence type and intent."""
    return df.withColumns({"question": F.col(text), "sentence_type": sentence_type(F.col(text)), "intent": intent(F.col(text))})


def intent_summary(df: DataFrame, text: str, model: Model, out: str = "summary") -> DataFrame:
    """Summary by the prompt of the row's intent, one model call a row."""
    prompt = None
    for k, p in SUMMARY_PROMPTS.items():
        r = render(p, text=F.col(text))
        prompt = F.when(F.col("intent").contains(k), r) if prompt is None else prompt.when(F.col("intent").contains(k), r)
    return df.withColumn(out, ask(prompt.otherwise(render(OTHER_PROMPT, text=F.col(text))), model))


def expected_queries(df: DataFrame, text: str, model: Model, out: str = "queries") -> DataFrame:
    """array<string> of the questions a text is expected to answer; short texts have none."""
    n = expected_count(F.col(text))
    prompt = F.when(n > 0, render(QUESTION_PROMPT, n=n, text=F.col(text)))
    return df.withColumn(out, F.coalesce(non_empty_lines(strip_list_marks(ask(prompt, model))), F.array().cast("array<string>")))


def verify_queries(df: DataFrame, text: str, queries: str, model: Model, out: str = "valid") -> DataFrame:
    """``df`` with the queries that the model confirms, in order: one call holds a text once with all its questions."""
    asked = F.transform(queries, lambda q: F.regexp_replace(q, r"\n+", " "))
    prompt = F.when(F.size(queries) > 0, render(CHECK_PROMPT, text=F.col(text), questions=F.array_join(asked, "\n")))
    verdicts = df.withColumn("_verdicts", F.split(ask(prompt, model), "\n", -1))
    kept = F.filter(F.col(queries), lambda q, i: is_yes(F.get(F.col("_verdicts"), i)))
    return verdicts.withColumn(out, F.coalesce(kept, F.array().cast("array<string>"))).drop("_verdicts")


def self_check(df: DataFrame, key: str, text: str, generate: Model | list[Model], check: Model, *, least: int = 3, max_rounds: int = 3) -> DataFrame:
    """(key, thread_id, queries, round, done): generate, verify, and try again for documents with under
    ``least`` valid queries. A retry replaces the list; only pending documents run again.
    The thread of a document is the same in all its rounds."""
    done, pending = None, df.select(key, F.col(text).alias("_t"))
    for r in range(1, max_rounds + 1):
        g = generate[min(r, len(generate)) - 1] if isinstance(generate, list) else generate
        drawn = expected_queries(pending, "_t", g, "_q")
        checked = cut_lineage(verify_queries(drawn, "_t", "_q", check).select(key, "valid", (F.size("valid") >= least).alias("_ok")))
        last = r == max_rounds
        out = checked.where(F.lit(True) if last else F.col("_ok")).select(key, stable_id(F.lit("self_check"), F.col(key)).alias("thread_id"), F.col("valid").alias("queries"), F.lit(r).alias("round"), F.col("_ok").alias("done"))
        done = out if done is None else done.unionByName(out)
        if last:
            break
        open_ones = checked.where("not _ok").select(key)
        if open_ones.isEmpty():
            break
        pending = pending.join(open_ones, key, "left_semi")
    return done


def answer(contexts: DataFrame, questions: DataFrame, model: Model, question: str = "question") -> DataFrame:
    """(query_id, answer) from each query's context."""
    both = contexts.join(questions.select("query_id", F.col(question).alias("_q")), "query_id")
    return both.select("query_id", ask(render(ANSWER_PROMPT, context=F.col("context"), question=F.col("_q")), model).alias("answer"))
