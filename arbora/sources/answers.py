"""Where model answers come from: replayed tables, a dry run, or a client called per prompt."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dry_run(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``response``: the prompt itself between markers."""
    return prompts.withColumn("response", F.concat(F.lit("## DRY-RUN ##\n"), F.col(prompt), F.lit("\n## END DRY-RUN ##")))


def replay(prompts: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """``prompts`` with the recorded ``response`` of the same keys, null where there is none."""
    return prompts.join(recorded.select(*keys, "response"), keys, "left")


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], prompt: str = "prompt", pause: float = 0.0) -> DataFrame:
    """``prompts`` with ``response`` from a client; an exception becomes a text that starts with ``PROCESSING_ERROR:``.

    ``client`` is called once in each task and returns the function that answers one prompt; between two prompts a task waits ``pause``
    seconds. Null prompts are not asked; an empty answer becomes ``ERROR: empty answer``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, last = client(), None
        for b in batches:
            out: list[str | None] = []
            for p in b.column(prompt).to_pylist():
                if p is None:
                    out.append(None)
                    continue
                if pause and last is not None:
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                try:
                    out.append(answer(p) or "ERROR: empty answer")
                except Exception as e:  # one failed call must not end the task
                    out.append(f"PROCESSING_ERROR: {e}")
                last = time.monotonic()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "response"])

    return prompts.mapInArrow(run, T.StructType([*prompts.schema, T.StructField("response", T.StringType())]))


def provider_client(model: str, *, max_tokens: int = 2000, temperature: float = 0.1, key: str | None = None) -> Callable[[], Callable[[str], str]]:
    """A client for ``ask`` of the provider that the model's name tells; its library is imported in the task, its key taken from the environment there."""

    def connect() -> Callable[[str], str]:
        if "claude" in model.lower():
            own = key or os.environ.get("ANTHROPIC_API_KEY")
            if not own:
                raise ValueError("no key for Anthropic")
            import anthropic

            messages = anthropic.Anthropic(api_key=own).messages
            return lambda p: _text(messages.create(model=model, max_tokens=max_tokens, temperature=temperature, messages=[{"role": "user", "content": p}]).content)
        own = key or os.environ.get("OPENAI_API_KEY")
        if not own:
            raise ValueError("no key for OpenAI")
        import openai

        chat = openai.OpenAI(api_key=own).chat.completions

        def answer(p: str) -> str:
            got = chat.create(model=model, max_tokens=max_tokens, temperature=temperature, messages=[{"role": "user", "content": p}]).choices
            return got[0].message.content if got else ""

        return answer

    return connect


def _text(content) -> str:
    return content[0].text if isinstance(content, list) and content else getattr(content, "text", "") or ""


def failed(responses: DataFrame) -> DataFrame:
    """``responses`` with ``is_error``: no response, or one that holds ``ERROR``."""
    return responses.withColumn("is_error", F.coalesce(F.contains("response", F.lit("ERROR")), F.lit(True)))
