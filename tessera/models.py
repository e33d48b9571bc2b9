"""Text models and embedders: the seam for anything that writes or reads language, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import math
import queue
import re
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import NO_INFO, STOPWORDS

# The default vocabulary of a graph.
ENTITY_TYPES = ["PERSON", "ORGANIZATION", "CONCEPT", "EVENT", "LOCATION", "DOCUMENT", "TECHNOLOGY", "PRODUCT"]
RELATION_TYPES = ["RELATED_TO", "PART_OF", "CREATED_BY", "LOCATED_IN", "REFERENCES", "OPPOSES", "SUPPORTS", "REGULATES"]
EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,relation:string,description:string>>"
SENTENCES = re.compile(r"(?<=[.!?])\s+")


class TextModel(Protocol):
    """Answers a prompt; ``task`` says what for: summarise, extract, community, relevance, answer, article, rewrite, resolve."""

    def complete(self, task: str, prompt: str, **fields: str) -> str: ...


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class ExtractiveModel:
    """A deterministic model without a network: it only selects and rearranges what it is given."""

    MENTION = re.compile(r"\b[A-Z][\w-]{2,}(?: [A-Z][\w-]{2,})*")

    def complete(self, task: str, prompt: str, **fields: str) -> str:
        return getattr(self, f"_{task}", self._summarise)(prompt, **fields)

    def _summarise(self, prompt: str, text: str = "", **_: str) -> str:
        return " ".join(SENTENCES.split((text or prompt).strip())[:8])

    def _mentions(self, sentence: str) -> list[str]:
        return list(dict.fromkeys(m for m in self.MENTION.findall(sentence) if m.lower() not in STOPWORDS))

    def _extract(self, prompt: str, text: str = "", **_: str) -> str:
        entities, relations = {}, []
        for s in SENTENCES.split(text):
            names = self._mentions(s)
            for n in names:
                entities.setdefault(n, {"name": n, "type": "CONCEPT", "description": s.strip()})
            relations += [{"source": a, "target": b, "relation": "RELATED_TO", "description": s.strip()} for a, b in zip(names, names[1:])]
        return "```json\n" + json.dumps({"entities": list(entities.values()), "relationships": relations}) + "\n```"

    def _community(self, prompt: str, text: str = "", **_: str) -> str:
        return " ".join(line.strip("- ") for line in text.splitlines() if line.strip())[:2000]

    def _relevance(self, prompt: str, text: str = "", question: str = "", **_: str) -> str:
        words = {w for w in re.findall(r"[a-z]{3,}", question.lower()) if w not in STOPWORDS}
        hits = [s for s in SENTENCES.split(text) if words & set(re.findall(r"[a-z]{3,}", s.lower()))]
        return " ".join(hits[:3]) if hits else NO_INFO

    def _answer(self, prompt: str, text: str = "", names: str = "", **_: str) -> str:
        known = sorted((n for n in names.split("\n") if n), key=lambda n: (-len(n), n))
        out = []
        for s in dict.fromkeys(SENTENCES.split(text.replace("\n", " "))):
            name = next((n for n in known if n in s), None)
            out.append(s.replace(name, f"[[{name}]]", 1) if name else s)
        return " ".join(out)

    def _article(self, prompt: str, text: str = "", **_: str) -> str:
        return "\n\n".join(p for p in text.split("\n\n") if p.strip())

    def _rewrite(self, prompt: str, text: str = "", **_: str) -> str:
        return " ".join(dict.fromkeys(SENTENCES.split(text)))

    def _resolve(self, prompt: str, **_: str) -> str:
        return "[]"


class HashingEmbedder:
    """Unit vectors of hashed words; equal texts have equal vectors on every machine."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w{3,}", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h & (1 << 40) else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


MODELS: dict[str, Callable[..., TextModel]] = {"extractive": ExtractiveModel}


def make_model(name: str = "extractive", **options) -> TextModel:
    """A registered model; user code adds its own under ``MODELS``."""
    if name not in MODELS:
        raise ValueError(f"no model named {name}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name](**options)


def extraction_prompt(entity_types: list[str], relation_types: list[str], context: str = "", triplets: int = 20) -> str:
    """Instructions to a model for taking entities and relationships from a text, which fills ``{text}``."""
    focus = context.strip().replace("{", "{{").replace("}", "}}")
    return "\n".join(
        [
            "List the entities of the text below and how they are related, as one JSON object with the keys entities and relationships.",
            f"Focus: {focus}" if focus else "Focus: everything of significance.",
            f"At most {triplets} relationships.",
            "Entity types: " + ", ".join(entity_types),
            "Relationship types: " + ", ".join(relation_types),
            "Write names in full and always alike, in American spelling, without an acronym in parentheses.",
            "Each entity has name, type and description; each relationship has source, target, relation and description.",
            "",
            "{text}",
        ]
    )


#: Seconds after which a call of a model is given up.
CALL_SECONDS = 300.0


def bounded(call: Callable[[], str], seconds: float = CALL_SECONDS) -> str:
    """What a call returns; ``TimeoutError`` if it takes longer.  The call that hangs is left behind in a daemon thread."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run():
        try:
            box.put((call(), None))
        except BaseException as e:
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        said, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error
    return said


def complete(model: TextModel, task: str, prompt: str, seconds: float = CALL_SECONDS, **fields: str) -> str:
    """A model's answer within a time, without the reasoning before it.

    An extraction by a model that has ``structured`` is asked for that way first, and as plain text if it cannot do it.
    """
    ask = getattr(model, "structured", None) if task == "extract" else None
    if ask is not None:
        try:
            return bounded(lambda: ask(task, prompt, **fields), seconds)
        except NotImplementedError:
            pass
    return bounded(lambda: model.complete(task, prompt, **fields), seconds).rsplit("</think>", 1)[-1].strip()


def stream(model: TextModel, task: str, prompt: str, **fields: str) -> Iterator[str]:
    """Pieces of an answer as the model gives them, reasoning left out; one piece where it cannot stream."""
    chunks = model.stream(task, prompt, **fields) if hasattr(model, "stream") else iter([bounded(lambda: model.complete(task, prompt, **fields))])
    return think_filter(chunks)


class ChatModel:
    """A model behind an HTTP service that speaks the usual chat-completions protocol."""

    def __init__(self, base_url: str, model: str, key: str = "", max_tokens: int = 2048, temperature: float = 0.0, seconds: float = CALL_SECONDS):
        self.url, self.model, self.key = base_url.rstrip("/") + "/chat/completions", model, key
        self.max_tokens, self.temperature, self.seconds = max_tokens, temperature, seconds

    def _open(self, prompt: str, **more):
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature} | more
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.seconds)

    def complete(self, task: str, prompt: str, **fields: str) -> str:
        with self._open(prompt) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    def structured(self, task: str, prompt: str, **fields: str) -> str:
        """The answer as one JSON object; ``NotImplementedError`` where the service refuses the format."""
        try:
            with self._open(prompt, response_format={"type": "json_object"}) as answer:
                return json.load(answer)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code in (400, 404, 415, 422, 501):
                raise NotImplementedError("structured answers") from e
            raise

    def stream(self, task: str, prompt: str, **fields: str) -> Iterator[str]:
        with self._open(prompt, stream=True) as answer:
            for line in answer:
                data = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
                if data and data != "[DONE]":
                    yield json.loads(data)["choices"][0].get("delta", {}).get("content") or ""


MODELS["chat"] = ChatModel


class SentenceEmbedder:
    """Vectors of an optional local encoder package, loaded once a worker; without the package it is not available."""

    _loaded: dict[str, object] = {}

    def __init__(self, name: str = "all-MiniLM-L6-v2"):
        self.name = name

    @staticmethod
    def available() -> bool:
        return importlib.util.find_spec("sentence_transformers") is not None

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self.name not in self._loaded:
            from sentence_transformers import SentenceTransformer

            self._loaded[self.name] = SentenceTransformer(self.name)
        return [list(map(float, v)) for v in self._loaded[self.name].encode(texts, normalize_embeddings=True)]


def map_model(rows: DataFrame, model: TextModel, task: str, keys: list[str], out: str = "answer", seconds: float = CALL_SECONDS) -> DataFrame:
    """``*keys, <out>, error``: the model's answer to ``prompt`` of each row, with the row's other columns as fields.

    A call that fails or takes longer than ``seconds`` gives a row with its error; reasoning before the answer is cut off.
    """
    fields = [c for c in rows.columns if c not in keys and c != "prompt"]
    head = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    answers.append(complete(model, task, row.get("prompt") or "", seconds, **{f: str(row[f] if row[f] is not None else "") for f in fields}))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[keys].assign(**{out: answers, "error": errors})

    return rows.mapInPandas(call, f"{head}, `{out}` string, error string")


def parsed_extractions(answers: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, entities, relationships`` of model answers; what is no valid JSON gives empty lists."""
    from tessera.functions.text import json_block, without_fence

    parsed = F.from_json(json_block(without_fence(F.coalesce("answer", F.lit("")))), EXTRACTION)
    e = answers.withColumn("x", parsed)
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return e.select(
        *keys,
        empty(F.col("x.entities"), "array<struct<name:string,type:string,description:string>>").alias("entities"),
        empty(F.col("x.relationships"), "array<struct<source:string,target:string,relation:string,description:string>>").alias("relationships"),
    )


def embed(texts: DataFrame, embedder: Embedder, keys: list[str]) -> DataFrame:
    """``*keys, vec``: vectors of ``text``, encoded a batch at a time."""
    head = ", ".join(f"`{c}` {t}" for c, t in texts.select(*keys).dtypes)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keys].assign(vec=embedder.encode([t or "" for t in pdf["text"]]))

    return texts.select(*keys, "text").mapInPandas(encode, f"{head}, vec array<double>")


def think_filter(chunks: Iterator[str], hold: int = 200) -> Iterator[str]:
    """Deltas of a streamed answer: cumulative or delta chunks in, reasoning held back until ``</think>`` closes it.

    Without an opening tag the text is let through once ``hold`` characters are there, or at the end.
    """
    seen, shown, open_ = "", 0, False
    for chunk in chunks:
        seen = chunk if seen and chunk.startswith(seen) else seen + chunk
        if not open_:
            if "</think>" in seen:
                shown, open_ = seen.rindex("</think>") + len("</think>"), True
                while shown < len(seen) and seen[shown].isspace():
                    shown += 1
            elif "<think>" in seen or len(seen) < hold:
                continue
            else:
                open_ = True
        if len(seen) > shown:
            yield seen[shown:]
            shown = len(seen)
    if not open_ and "<think>" not in seen and seen:
        yield seen
