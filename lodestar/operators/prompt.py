"""Prompt assembly: retrieved chunks of each question, in rank order, inside a template.

One ``groupBy(query_id)`` over at most ``k + 2`` rows per question; the ordered
lines are sorted by rank inside the group and joined natively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# ---------------------------------------------------------------------------
# The reference's prompt templates, character for character
# (four-space indentation, a trailing space after two instruction lines).
# ``{context}`` and ``{query}`` mark where the assembled text goes.
# ---------------------------------------------------------------------------
TEMPLATE_STRUCTURED = (
    "\n"
    "    ### Instructions for LLM:\n"
    "    - **Only answer based on the retrieved context.** \n"
    "    - **Do not mix Non-RT RIC and Near-RT RIC roles.**\n"
    "    - **Exclude security considerations unless explicitly mentioned in the retrieved context.**\n"
    "\n"
    "    ### Retrieved Context:\n"
    "    {context}\n"
    "\n"
    "    ### Query:\n"
    "    {query}\n"
    "\n"
    "    ### Expected Output:\n"
    "    Provide a structured and accurate response strictly from the context.\n"
    "    "
)
TEMPLATE_STRUCTURED_WEB = (
    "\n"
    "    ### Instructions for LLM:\n"
    "    - **Only answer based on the retrieved context. if present** \n"
    "    - **Do not mix Non-RT RIC and Near-RT RIC roles.**\n"
    "    - **Exclude security considerations unless explicitly mentioned in the retrieved context.**\n"
    "\n"
    "    ### Retrieved Context:\n"
    "    {context}\n"
    "\n"
    "    ### Query:\n"
    "    {query}\n"
    "\n"
    "    ### Expected Output:\n"
    "    Provide a structured and accurate response strictly from the context.\n"
    "    "
)
TEMPLATE_EVALUATION = (
    "\n"
    "    ### Instructions for LLM:\n"
    "    - **Strictly answer based on retrieved context only.**\n"
    "    - **Keep responses under 50 words.**\n"
    "    - **Use exact document phrasing where applicable.**\n"
    "    \n"
    "    ### Retrieved Context:\n"
    "    {context}\n"
    "\n"
    "    ### Query:\n"
    "    {query}\n"
    "    "
)
TEMPLATE_GENERIC = (
    "\n"
    "    ### Query:\n"
    "    {query}\n"
    "\n"
    "    ### Expected Output:\n"
    "    Provide a structured and accurate response.\n"
    "    "
)
# ---------------------------------------------------------------------------

TEMPLATES = {
    "structured": TEMPLATE_STRUCTURED,
    "structured_web": TEMPLATE_STRUCTURED_WEB,
    "evaluation": TEMPLATE_EVALUATION,
    "generic": TEMPLATE_GENERIC,
}
#: variants whose context lines carry the source title
WITH_SOURCE = {"structured", "structured_web"}


def fill(template: str, context: Column | None, query: Column) -> Column:
    """Substitute ``{context}`` and ``{query}`` with column values (no format parsing)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i_c = rest.find("{context}")
        i_q = rest.find("{query}")
        hits = [(i, tag) for i, tag in ((i_c, "{context}"), (i_q, "{query}")) if i >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        i, tag = min(hits)
        parts.append(F.lit(rest[:i]))
        parts.append(context if tag == "{context}" else query)
        rest = rest[i + len(tag):]
    return F.concat(*parts)


def context_lines(retrieved: DataFrame, variant: str = "structured", qid: str = "query_id") -> DataFrame:
    """``(query_id, context)``: lines in rank order joined by a newline."""
    if variant in WITH_SOURCE:
        line = F.concat(F.lit(P.SOURCE_LINE_PREFIX), F.coalesce(F.col("source"), F.lit("None")), F.lit("\n"),
                        F.coalesce(F.col("content"), F.lit("")))
    else:
        line = F.coalesce(F.col("content"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return retrieved.groupBy(qid).agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context"))


def assemble_prompt(questions: DataFrame, retrieved: DataFrame, variant: str = "structured",
                    qid: str = "query_id", query_col: str = "query", template: str | None = None) -> DataFrame:
    """``(query_id, prompt)`` for every question; a question with nothing retrieved gets an empty context.

    ``template`` replaces the variant's text (with other rules for a domain, say); the variant still
    decides how context lines look.  A template without ``{context}`` needs no retrieval.
    """
    template = TEMPLATES[variant] if template is None else template
    if "{context}" not in template:
        return questions.select(qid, fill(template, None, F.col(query_col)).alias("prompt"))
    ctx = context_lines(retrieved, variant, qid)
    joined = questions.select(qid, query_col).join(ctx, qid, "left")
    return joined.select(qid, fill(template, F.coalesce(F.col("context"), F.lit("")), F.col(query_col)).alias("prompt"))


def answers(rag_prompts: DataFrame, generic_prompts: DataFrame, answerer, qid: str = "query_id") -> DataFrame:
    """``query_id, rag_answer, generic_answer``: both prompts of every question through ``answerer``.

    ``answerer`` takes a list of prompts and returns as many texts; it is called once per Arrow batch inside the
    tasks, so a model is loaded where it runs.  A question without a prompt has a null answer.
    """
    def ask(batches):
        for b in batches:
            yield b.assign(answer=list(answerer(b["prompt"].tolist())))

    both = rag_prompts.select(qid, "prompt", F.lit("rag").alias("kind")).unionByName(
        generic_prompts.select(qid, "prompt", F.lit("generic").alias("kind")))
    fields = [f"`{qid}` {both.schema[qid].dataType.simpleString()}", "prompt string", "kind string", "answer string"]
    got = both.where(F.col("prompt").isNotNull()).mapInPandas(ask, ", ".join(fields))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("answer"))).alias(f"{kind}_answer")
    return got.groupBy(qid).agg(pick("rag"), pick("generic"))
