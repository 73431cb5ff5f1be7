"""Chunk, ask a model, parse, merge, align: annotation of documents by a pluggable model.

`predict` is any function from a list of prompts to a list of replies; it runs within
tasks, a batch at a time.  Nothing here talks to a network.
"""

from __future__ import annotations

import configparser
import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from glossa.functions.inline import SPAN_ROWS, _numbered, aligned_spans, loose_spans, pack_lines, parse_reply, place_entities, rows_from, safe_limit
from glossa.functions.text import clean_answer, labelled_line
from glossa.plans.ledger import Ledger, prompt_digest
from glossa.sources import files
from glossa.sources.writers import span_xml

Predict = Callable[[list[str]], list[str]]

#: Fixed value: the place of the text in a prompt.
SLOT = "{texto_clinico}"


@dataclass
class Settings:
    """What a batch run needs; max_files None is no limit."""

    models: list[str] = field(default_factory=list)
    prompts: list[str] = field(default_factory=list)
    max_files: int | None = None
    context: int = 2048
    margin: float = 0.1
    attempts: int = 3

    @property
    def limit(self) -> int:
        return safe_limit(self.context, self.margin)


def read_settings(text: str, section: str | None = None) -> Settings:
    """Settings from INI text: case of keys kept, `=` alone parts them; a bad or non-positive max_files is no limit."""
    parser = configparser.ConfigParser(delimiters=("=",))
    parser.optionxform = str
    parser.read_string(text)
    values = dict(parser[section or parser.sections()[0]])
    names = lambda key: [x.strip() for x in values.get(key, "").split(",") if x.strip()]
    try:
        most = int(values.get("max_files", ""))
    except ValueError:
        most = 0
    context = int(values.get("context", "2048"))
    if context <= 0:
        raise ValueError("context must be a positive number of tokens")
    return Settings(names("models"), names("prompts"), most if most > 0 else None, context)


def policy(prompt: str, settings: Settings) -> dict:
    """Per-prompt settings: no grammar for prompt1, a long context for prompt5 if it is the last."""
    long_ = prompt == "prompt5" and settings.prompts[-1:] == ["prompt5"]
    return {"grammar": prompt != "prompt1", "context": 8192 if long_ else settings.context}


def _answers(chunks: list[str], predict: Predict, template: str, attempts: int, wait: float, sleep: Callable[[float], None]) -> list[tuple[str, dict[str, list[str]], bool]]:
    """tagged text, entities by tag, and whether a reply did parse, of each chunk."""
    parsed: list[dict | None] = [None] * len(chunks)
    for attempt in range(attempts):
        todo = [i for i, p in enumerate(parsed) if p is None]
        if not todo:
            break
        if attempt:
            sleep(wait * 2 ** (attempt - 1))
        for i, reply in zip(todo, predict([template.replace(SLOT, chunks[i]) for i in todo]), strict=True):
            parsed[i] = parse_reply(reply or "")

    def values(p: dict) -> dict[str, list[str]]:
        return {str(k): [str(x) for x in (v if isinstance(v, list | tuple | set) else [v])] for k, v in (p.get("entidades") or {}).items()}

    return [(c, {}, False) if p is None else (str(p.get("texto_anotado", c)), values(p), True) for c, p in zip(chunks, parsed, strict=True)]


def ask(chunks: DataFrame, predict: Predict, template: str = SLOT, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds tagged_text, entities, answered to chunks with a column chunk; a null chunk is not asked.

    A reply that does not parse is asked for again after 2, then 4 seconds; after the
    last attempt the chunk stands as it is, without entities.  The model is asked when
    the result is computed, so each time; a Ledger keeps replies.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes) + ", tagged_text string, entities map<string,array<string>>, answered boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            real = f["chunk"].notna()
            found = iter(_answers(f["chunk"][real].tolist(), predict, template, attempts, wait, sleep))
            rows = [next(found) if r else (None, {}, False) for r in real]
            yield f.assign(tagged_text=[r[0] for r in rows], entities=[r[1] for r in rows], answered=[r[2] for r in rows])

    return chunks.mapInPandas(run, schema)


def merge_parts(answers: DataFrame, keys: list[str], multiplicity: bool = False) -> DataFrame:
    """keys, tagged_text (parts joined by blank lines in order), entities (distinct values by tag, or all if multiplicity).

    One aggregation, so what answers is made of is computed once.  Null texts are left out, null maps are empty.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "tagged_text", F.map_entries("entities").alias("named"))))
    rows = answers.groupBy(*keys).agg(parts.alias("_parts"))
    named = F.flatten(F.transform("_parts", lambda p: F.coalesce(p["named"], F.array().cast("array<struct<key:string,value:array<string>>>"))))
    rows = rows.select(*keys, F.array_join(F.transform("_parts", lambda p: p["tagged_text"]), "\n\n").alias("tagged_text"), named.alias("_named"))
    tags = F.array_sort(F.array_distinct(F.transform("_named", lambda e: e["key"])))
    values = lambda tag: F.flatten(F.transform(F.filter("_named", lambda e: e["key"] == tag), lambda e: F.coalesce(e["value"], F.array().cast("array<string>"))))
    gather = lambda tag: F.array_sort(values(tag) if multiplicity else F.array_distinct(values(tag)))
    return rows.select(*keys, "tagged_text", F.map_from_arrays(tags, F.transform(tags, gather)).alias("entities"))


def parts_of(text: str, length: Callable[[str], int], limit: int, template: str = SLOT) -> list[tuple[str | None, bool]]:
    """What is asked of a text: the text as it is if its prompt fits the limit, else its chunks of lines.

    A text without a line that could be asked has one part that is null, so that it is not lost.
    """
    if length(template.replace(SLOT, text)) <= limit:
        return [(text, False)]
    return pack_lines(text, length, limit, template) or [(None, False)]


def asked_parts(docs: DataFrame, keys: list[str], limit: int, template: str = SLOT, length: Callable[[str], int] = len) -> DataFrame:
    """keys, part, chunk, oversize of every document."""
    return rows_from(docs, ["text"], keys, lambda t: [(i, c, over) for i, (c, over) in enumerate(parts_of(t, length, limit, template))], "part int, chunk string, oversize boolean")


def annotate(docs: DataFrame, predict: Predict, keys: list[str], settings: Settings, template: str = SLOT, length: Callable[[str], int] = len, **how) -> DataFrame:
    """keys, tagged_text, entities of each document, whole if its prompt fits the limit, else by chunks of lines.

    The model is asked once a part whenever the result is computed.
    """
    return merge_parts(ask(asked_parts(docs, keys, settings.limit, template, length), predict, template, settings.attempts, **how), keys)


def pending(docs: DataFrame, done: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Documents without an entry in the table of finished runs, in order of their keys, at most `most`."""
    left = docs.join(done.select(*keys).distinct(), keys, "left_anti")
    return left.orderBy(*keys).limit(most) if most else left


def filed_as(prompt: str, settings: Settings) -> str:
    """The name under which a prompt's results are filed: a run with a context of its own has the context in it, so both can stand side by side."""
    context = policy(prompt, settings)["context"]
    return prompt if context == settings.context else f"{prompt}_context{context}"


def finished(docs: DataFrame, done_path: str, keys: list[str], model: str, prompt: str) -> DataFrame:
    """What the table at done_path holds for a model and a filed prompt: keys, tagged_text, entities, run.  Other models' and prompts' files are not read."""
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tagged_text string, entities map<string,array<string>>, model string, prompt string, run string"
    if not files.exists(spark, done_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(done_path).where((F.col("model") == model) & (F.col("prompt") == prompt))


def annotate_batch(docs: DataFrame, done_path: str, predict: Predict, model: str, prompt: str, keys: list[str], settings: Settings, constrained: Predict | None = None, ledger_path: str | None = None, template: str = SLOT, length: Callable[[str], int] = len, **how) -> int:
    """Annotates what the table at done_path lacks for this model and prompt, and appends it; returns how many.

    The prompt's policy sets the context, under which name results are filed, and whether
    the model is asked under a grammar (`constrained`, if given).  Replies go to a ledger
    first (by default beside the table), so no chunk is asked for twice, whatever fails.
    """
    todo = pending(docs, finished(docs, done_path, keys, model, filed_as(prompt, settings)), keys, settings.max_files)
    return write_batch(todo, done_path, predict, Ledger(ledger_path or done_path.rstrip("/") + "_replies", model, filed_as(prompt, settings)), prompt, keys, settings, constrained, template, length, **how)


def write_batch(todo: DataFrame, done_path: str, predict: Predict, ledger: Ledger, prompt: str, keys: list[str], settings: Settings, constrained: Predict | None = None, template: str = SLOT, length: Callable[[str], int] = len, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Annotates the documents and writes them as the ledger's job to the table at done_path; what that job wrote before gives way.  Returns how many."""
    spark, own = todo.sparkSession, policy(prompt, settings)
    settings = replace(settings, context=own["context"])
    model = constrained if constrained and own["grammar"] else predict
    # chunks are cut once; the table also holds on to which documents are meant
    held = f"{ledger.path}/_parts-{ledger.job}"
    asked_parts(todo, keys, settings.limit, template, length).withColumn("digest", prompt_digest(template, SLOT, F.col("chunk"))).write.mode("overwrite").parquet(held)
    parts = spark.read.parquet(held)
    ledger.fill(parts.select("digest", "chunk"), lambda chunks: _answers(chunks, model, template, settings.attempts, wait, sleep))
    merged = merge_parts(parts.join(ledger.replies(spark), "digest", "left"), keys)
    filed = merged.select(*keys, "tagged_text", "entities", F.lit(ledger.model).alias("model"), F.lit(ledger.prompt).alias("prompt"), F.lit(ledger.job).alias("run"))
    seen = Observation()
    filed = filed.observe(seen, F.count(F.lit(1)).alias("n"))
    filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "prompt", "run").parquet(done_path)
    files.remove(spark, held)
    return seen.get["n"]


def known_model(model: str, contexts: dict[str, int]) -> int:
    """The context of a model; one that is not listed raises an error before anything runs."""
    if model not in contexts:
        raise ValueError(f"unknown model {model}; known are {', '.join(sorted(contexts))}")
    return contexts[model]


def token_length(path: str) -> Callable[[str], int]:
    """A length for `asked_parts` and `annotate`: tokens by the tokenizer of a .json file, read once a worker process."""

    def length(text: str) -> int:
        return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)

    return length


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The labels of a name reply's lines, and the types of what they name.
NAME_LINES = {"NOMBRE_PACIENTE": "NOMBRE_SUJETO_ASISTENCIA", "APELLIDOS_PACIENTE": "NOMBRE_SUJETO_ASISTENCIA", "MEDICO": "NOMBRE_PERSONAL_SANITARIO"}


def name_spans(replies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, start, end, tag, text: all places, whatever case and accents, of the names in labelled replies.

    replies has text and reply.  Names are cleaned, places do not overlap (longer ones
    win), and a null reply names nothing.
    """
    named = replies.select(*keys, "text", *(clean_answer(labelled_line(F.coalesce("reply", F.lit("")), x)).alias(f"_{x}") for x in NAME_LINES))
    return loose_spans(named, keys, {f"_{x}": kind for x, kind in NAME_LINES.items()})


def tag_names(docs: DataFrame, predict: Predict, key: str = "doc_id", template: str = SLOT) -> DataFrame:
    """key, xml: documents asked for three names each, the names placed and written as span XML."""
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(reply=predict([template.replace(SLOT, t or "") for t in f["text"]]))

    # asked once: the spans and the texts of the XML come from one pass over the replies
    asked = docs.select(key, "text").mapInPandas(run, f"`{key}` {kind}, text string, reply string")
    spans = name_spans(asked, [key]).withColumn("type", F.col("tag")).withColumn("category", F.lit("NAME"))
    return span_xml(docs, spans, key)


def reply_spans(replies: DataFrame, texts: DataFrame, keys: list[str] = ["system", "doc_id"]) -> DataFrame:  # noqa: B006
    """mode, keys, ord, start, end, tag, text of stored replies in both ways at once.

    Mode `entities` places the listed values at their first occurrences, mode `tagged`
    the inline tags at the nearest free ones.  Replies whose document has no text are
    left out.
    """
    rows = replies.join(texts.select("doc_id", "text"), "doc_id")
    values = rows.withColumn("names", F.map_keys("entities")).withColumn("lists", F.map_values("entities"))
    make = lambda text, names, lists: _numbered(place_entities(text, {n: [str(v) for v in found] for n, found in zip(names, lists, strict=True)}))
    listed = rows_from(values.where("entities is not null"), ["text", "names", "lists"], keys, make, SPAN_ROWS)
    tagged = aligned_spans(rows.select(*keys, "text", "tagged_text"), keys)
    return listed.select(F.lit("entities").alias("mode"), "*").unionByName(tagged.select(F.lit("tagged").alias("mode"), "*"))


def grammar(tags: list[str]) -> str:
    """A grammar for replies: text and tags of the given names, opened and closed alike."""
    names = " | ".join(f'"{t}"' for t in tags)
    return f'root ::= (text | entity)*\nentity ::= "<" name ">" text "</" name ">"\nname ::= {names}\ntext ::= [^<>]+\n'


def under_grammar(model: Callable[[list[str], str], list[str]], tags: list[str]) -> Predict:
    """A `constrained` for annotate_batch: a model that takes prompts and a grammar, bound to the grammar of the tags."""
    return functools.partial(_with_grammar, model, grammar(tags))


def _with_grammar(model: Callable[[list[str], str], list[str]], rules: str, prompts: list[str]) -> list[str]:
    return model(prompts, rules)
