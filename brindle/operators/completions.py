"""Language-model column operators: rows are prompted in batches through a client that the caller supplies.

A client is any picklable ``complete(system, user, provider, temperature) -> str``; tests use a deterministic one. Calls may
differ between runs, so write or persist the result before using it twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import semantics as S
from brindle.functions.scalars import fill_template

Client = Callable[[str, str, str, float], str]


@dataclass(frozen=True)
class Ask:
    """What a module asks: the system prompt, the columns of the answer, and the prompt's column or template."""

    system: str
    outputs: tuple[str, ...]
    column: str | None = None
    template: str | None = None


@dataclass(frozen=True)
class Settings:
    provider: str = "default"
    temperature: float = 0.2
    batch_size: int = 20
    max_rows: int = 0
    extra: dict = field(default_factory=dict)


def reformat(column: str, output: str | None = None, target: str = "a consistent format") -> Ask:
    return Ask(f"Rewrite each value as {target}. Answer with the rewritten value alone; leave a value that cannot be rewritten as it is.", (output or column,), column)


def cleanse(column: str, output: str | None = None, rules: str = "Correct spelling and remove outer white space.") -> Ask:
    return Ask(f"Clean each value by these rules and answer with the cleaned value alone:\n{rules}", (output or column,), column)


def sentiment(column: str, output: str = "Sentiment", include_score: bool = True, labels: str = "positive,neutral,negative") -> Ask:
    score = f" Give your confidence from 0 to 1 as {output}Score." if include_score else ""
    return Ask(f"Name the sentiment of each text as exactly one of: {labels}.{score}", (output, f"{output}Score") if include_score else (output,), column)


def classify(column: str, output: str = "Category", categories: str = "other") -> Ask:
    names = [c.strip() for c in categories.splitlines() if c.strip()] or ["other"]
    return Ask(f"Sort each text into exactly one of these categories: {', '.join(names)}. Use {names[-1]} when none fits.", (output,), column)


def extract(column: str, fields: str) -> Ask:
    names = tuple(f.strip() for f in fields.splitlines() if f.strip())
    if not names:
        raise ValueError("List at least one field to extract, one per line.")
    return Ask("Copy the asked fields out of each text. Leave a field empty when the text lacks it; add nothing.", names, column)


def prompt(template: str, output: str = "LlmOutput", system: str = "Work on one row of data at a time and answer with the asked result alone.") -> Ask:
    return Ask(system, (output,), None, template)


def rendered_prompts(df: DataFrame, ask: Ask):
    """The prompt of each row, as a column."""
    return fill_template(df, ask.template) if ask.template is not None else S.key(S.required(df, ask.column))


def batch_request(prompts: list[str], outputs: tuple[str, ...]) -> str:
    lines = [f"{i}. {p.replace(chr(10), ' ')}" for i, p in enumerate(prompts, 1)]
    return "\n".join(["Inputs, numbered, one per line:", *lines, "", f"Answer with a JSON array of exactly {len(prompts)} objects in the same order, each with the keys {', '.join(outputs)}, and nothing else."])


def single_request(text: str, outputs: tuple[str, ...]) -> str:
    return f"{text}\n\nAnswer with one JSON object with the keys {', '.join(outputs)} and nothing else."


def parse_reply(reply: str, outputs: tuple[str, ...]) -> list[dict[str, str | None]]:
    """The objects of a reply, in a code fence or not; none if it is no JSON. A bare value answers the first column."""
    text = reply.strip()
    if text.startswith("```"):
        first, last = text.find("\n"), text.rfind("```")
        if 0 < first < last:
            text = text[first + 1 : last].strip()
    try:
        found = json.loads(text)
    except ValueError:
        return []
    if isinstance(found, dict):
        found = [found]
    if not isinstance(found, list):
        return []
    shown = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    return [{o: shown(x[o]) for o in outputs if o in x} if isinstance(x, dict) else {outputs[0]: shown(x)} for x in found]


def answers(prompts: list[str], ask: Ask, client: Client, settings: Settings) -> list[dict[str, str | None]]:
    """One answer per prompt; a batch whose reply does not line up is asked again row by row."""
    found = parse_reply(client(ask.system, batch_request(prompts, ask.outputs), settings.provider, settings.temperature), ask.outputs)
    if len(found) == len(prompts):
        return found
    out = []
    for p in prompts:
        one = parse_reply(client(ask.system, single_request(p, ask.outputs), settings.provider, settings.temperature), ask.outputs)
        out.append(one[0] if one else {})
    return out


def apply(df: DataFrame, ask: Ask, client: Client, settings: Settings = Settings(), order: str | list[str] | None = None) -> DataFrame:
    """``df`` with the answer's columns, which replace columns of those names.

    With ``max_rows``, rows after the first ones by ``order`` (ties and no order: as scanned) are left untouched: all
    other rows are compared with the last answered one, so they stay where they are."""
    size = min(max(settings.batch_size, 1), 200)
    wide = df.withColumn("_prompt", rendered_prompts(df, ask))
    done, rest = wide, None
    if settings.max_rows > 0:
        ordered, row = S.row_order(wide, order)
        ordered = ordered.withColumn(row, F.struct(F.col(row).alias("by"), F.monotonically_increasing_id().alias("at")))
        first = ordered.orderBy(row).limit(settings.max_rows)
        last = first.agg(F.max(row).alias("_last"))
        done = first.drop(row)
        rest = ordered.crossJoin(F.broadcast(last)).where(F.col(row) > F.col("_last")).drop(row, "_last", "_prompt")  # one row
    answered = [o for o in ask.outputs]
    lowered = {o.lower() for o in answered}
    kept = [f for f in df.schema.fields if f.name.lower() not in lowered]
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"`{o}` string" for o in answered]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[dict] = []
            for at in range(0, len(part), size):
                found += answers(part["_prompt"].iloc[at : at + size].tolist(), ask, client, settings)
            out = part[[f.name for f in kept]].copy()
            for o in answered:
                out[o] = [a.get(o) for a in found]
            yield out

    out = done.mapInPandas(run, ", ".join(schema))
    if rest is not None:
        untouched = rest.select(*[S.col(f) for f in kept], *[(S.render(f) if (f := S.field(df, o)) else F.lit(None).cast("string")).alias(o) for o in answered])
        out = out.unionByName(untouched)
    order_of = [f.name for f in df.schema.fields if f.name.lower() in lowered]
    return out.select(*[c for c in [*df.columns] if c not in order_of and S.field(out, c)], *answered)
