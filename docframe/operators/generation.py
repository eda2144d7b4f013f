"""Stages around a language model: prompts in, validated structs out; a failing row is data, not a failed job."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions.compat import strip
from docframe.operators.calls import Client, answered
from docframe.operators.evidence import attach_evidence, surviving_quotes
from docframe.operators.hardware import flag_variant, reconcile_name
from docframe.operators.opportunity import salvage_object
from docframe.operators.records import classify_failure
from docframe.operators.rendering import render_notices

#: The version of the summary prompt.
PROMPT_VERSION = "notice-summary-2026-08-28-v3"


class ReplayClient:
    """Answers from a table of recorded ones, by the first recorded key that the prompt holds."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def __call__(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), self.default)


def summarize(notices: DataFrame, client: Client, model: str, budget: int | None = None, documents: DataFrame | None = None, version: str = PROMPT_VERSION, **asking) -> DataFrame:
    """(notice_no, summary, prompt_version, llm_model, failure) of each notice.

    notices: notice_no, prompt; or, with documents (see render_notices),
    notice_no, title, agency, amount, whose prompts are rendered within budget.
    A notice with neither title nor number isn't asked for: BAD_REQUEST. asking:
    further parameters of calls.answered, as for the other stages below.
    """
    if documents is not None:
        known = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.col("notice_no").cast("string"), F.lit(""))).isNotNull()
        prompts = render_notices(notices, documents, budget)
        notices = prompts.join(notices.select("notice_no", known.alias("known")), "notice_no").select("notice_no", F.when(F.col("known"), F.col("prompt")).alias("prompt"))
    asked = answered(notices, "prompt", client, "__a", **asking)
    failed = F.col("__a.error").isNotNull()
    return asked.select("notice_no", strip(F.col("__a.text")).alias("summary"), F.when(~failed, F.lit(version)).alias("prompt_version"), F.when(~failed, F.lit(model)).alias("llm_model"), F.when(failed, classify_failure(F.col("__a.error"))).alias("failure"))


CONSTRAINT = "struct<attr:string,op:string,value:variant,unit:string,raw:string>"
PART = f"category:string,name:string,named:boolean,qty:bigint,unit:string,constraints:array<{CONSTRAINT}>,allow_equivalent:boolean,evidence:string"
ITEM = f"struct<{PART},prebuilt:boolean,children:array<struct<{PART}>>,notes:array<string>>"


def tidy(part: Column) -> Column:
    """An item or a child with flags folded, its name reconciled, and a quantity of 1 at least; a constraint's value is a flag, a number or a text, as the model wrote it."""
    name, named = reconcile_name(part["name"], part["named"])
    folded = F.transform(part["constraints"], lambda c: c.withField("value", flag_variant(c["attr"], c["value"])))
    return part.withField("name", name).withField("named", named).withField("constraints", folded).withField("qty", F.greatest(F.lit(1), F.coalesce(part["qty"], F.lit(1))))


def tidy_item(item: Column) -> Column:
    """tidy of an item and of each of its children."""
    own = tidy(item)
    return own.withField("children", F.transform(own["children"], tidy))


def extract_requirements(texts: DataFrame, client: Client, key: str = "doc_id", **asking) -> DataFrame:
    """A row for each item that the model finds in (key, text): its fields and children tidied, evidence of both located."""
    asked = answered(texts, "text", client, "__a", **asking)
    items = asked.select(key, "text", F.explode(salvage_object(F.col("__a.text"), f"struct<items:array<{ITEM}>>")["items"]).alias("i"))
    tidied = items.withColumn("i", tidy_item(F.col("i")))
    return attach_evidence(tidied.select(key, "text", "i.*")).drop("text")


def response_schema(schema: T.StructType, server_filled: tuple[str, ...] = ("evidence_span",)) -> T.StructType:
    """The schema that a model is asked for: without the fields, at any depth, that are filled in afterwards."""

    def pruned(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, pruned(f.dataType), f.nullable) for f in kind if f.name not in server_filled])
        return T.ArrayType(pruned(kind.elementType), kind.containsNull) if isinstance(kind, T.ArrayType) else kind

    return pruned(schema)


def constrained(client: Callable[[str, str], str], schema: T.StructType) -> Client:
    """A client of prompts from one that takes a prompt and a JSON text of the schema to answer in; what it answers is still parsed and checked."""
    wanted = response_schema(schema).json()
    return lambda prompt: client(prompt, wanted)


def dump_responses(prompts: DataFrame, client: Client, path: str, key: str, **asking) -> None:
    """The client's raw answers to (key, prompt) as JSON lines."""
    answered(prompts, "prompt", client, **asking).select(key, "answer.text", "answer.error").write.mode("overwrite").json(path)


def extract_datasheet(texts: DataFrame, client: Client, schema: str, key: str = "doc_id", **asking) -> DataFrame:
    """The fields of schema (with quotes map<string,string>) that the model finds; quotes that don't occur in the text go."""
    found = answered(texts, "text", client, "__a", **asking).withColumn("sheet", salvage_object(F.col("__a.text"), schema))
    return found.select(key, F.col("sheet").withField("quotes", surviving_quotes(F.col("sheet.quotes"), F.col("text"))).alias("sheet"), F.col("__a.error").alias("error"))


def recorded(answer: dict) -> str:
    return json.dumps(answer, ensure_ascii=False)
