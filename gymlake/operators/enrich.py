"""The boundary to models: a table in, a table out, through a client that is passed in.

A client is a callable from a list of prompts to a list of replies. It is made on
the executor, once per partition, by the factory given, so nothing of it is
shipped but the factory. Transient errors are retried with a linear pause; a
prompt that still fails gives a null reply and its error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[list[str]], list[str]]


def echo_client() -> Client:
    """Deterministic stand-in: the prompt's last line, reversed."""
    return lambda prompts: [p.rsplit("\n", 1)[-1][::-1] for p in prompts]


def enrich(df: DataFrame, prompt: str, reply: str, make_client: Callable[[], Client] = echo_client, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """df with columns `reply` and `error`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{reply}` string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            replies, errors = [], []
            for text in pdf[prompt].fillna(""):
                answer, error = None, None
                for attempt in range(1, attempts + 1):
                    try:
                        answer, error = client([text])[0], None
                        break
                    except (ConnectionError, TimeoutError) as e:
                        error = type(e).__name__
                        if attempt < attempts:
                            time.sleep(pause * attempt)
                replies.append(answer)
                errors.append(error)
            yield pdf.assign(**{reply: replies, "error": errors})

    return df.mapInPandas(run, schema)
