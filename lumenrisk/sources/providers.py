"""Where captions and captures come from: named providers that run on partitions, one bad item never costs a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Provider(Protocol):
    """What a model has to offer; items and results are plain dictionaries."""

    num_layers: int
    num_visual_tokens: int

    def generate(self, item: dict) -> dict: ...

    def generate_batch(self, items: list[dict]) -> list[dict]: ...


class CaptureProvider(Provider, Protocol):
    """A model that also gives its inner states: one dictionary for each layer, in the order of the layers."""

    def capture(self, item: dict, prefix: list[int], index: int, target: int) -> list[dict]:
        """States before the token at ``index`` of the response, whose first tokens are ``prefix``."""


def capture_batch(provider: CaptureProvider, item: dict, ids: list[int], indices: list[int], targets: list[int]) -> list[list[dict]]:
    """The captures of several tokens of a response: the provider's own ``capture_batch``, else one after the other."""
    own = getattr(provider, "capture_batch", None)
    if own is not None:
        return own(item, ids, indices, targets)
    return [provider.capture(item, ids[:i], i, t) for i, t in zip(indices, targets, strict=True)]


_KNOWN: dict[str, Callable[[dict], Provider]] = {}


def register(name: str, factory: Callable[[dict], Provider]) -> None:
    _KNOWN[name] = factory


def build(name: str, config: dict) -> Provider:
    if name not in _KNOWN:
        raise ValueError(f"unknown provider {name!r}; one of {sorted(_KNOWN)}")
    return _KNOWN[name](config)


def provide(rows: DataFrame, factory: Callable[[], Provider], key: str, result: T.StructType, batch: int = 16) -> DataFrame:
    """(key, result columns, error): the provider's results for the items of ``rows``.

    A batch that fails is run again item by item; an item that fails gives its error in place of a result.
    """
    schema = T.StructType([rows.schema[key], *result, T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                items = frame.iloc[at : at + batch].to_dict("records")
                try:
                    got = [(r, None) for r in provider.generate_batch(items)]
                except Exception:  # noqa: BLE001 whatever a provider raises belongs to one of its items
                    got = [_one(provider, i) for i in items]
                out = [{key: i[key], **{f.name: (r or {}).get(f.name) for f in result}, "error": e} for i, (r, e) in zip(items, got, strict=True)]
                yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(run, schema)


def provide_captures(rows: DataFrame, factory: Callable[[], CaptureProvider], key: str, result: T.StructType) -> DataFrame:
    """(key, span_idx, layer, result columns, error): captures of each row's tokens, one row a layer.

    ``rows`` holds the item's columns, response_token_ids, and spans: array<struct<span_idx, response_token_idx,
    target_token_id>>; a null target is the response's own token there. An item whose call fails is run again token by
    token; a token that fails gives one row with its error and a null layer, one outside the response likewise. Items
    without spans give no row.
    """
    schema = T.StructType([rows.schema[key], T.StructField("span_idx", T.IntegerType()), T.StructField("layer", T.IntegerType()), *result, T.StructField("error", T.StringType())])
    names = [f.name for f in result]

    def tokens(provider: CaptureProvider, item: dict) -> Iterator[dict]:
        ids, spans = [int(i) for i in item.pop("response_token_ids")], item.pop("spans")
        inside = [s for s in spans if 0 <= s["response_token_idx"] < len(ids)]
        at = [int(s["response_token_idx"]) for s in inside]
        targets = [ids[i] if s["target_token_id"] is None else int(s["target_token_id"]) for i, s in zip(at, inside, strict=True)]
        try:
            got = [(c, None) for c in capture_batch(provider, item, ids, at, targets)] if inside else []
            if len(got) != len(inside):
                raise ValueError(f"{len(got)} captures for {len(inside)} tokens")
        except Exception:  # noqa: BLE001 whatever a provider raises belongs to one of its tokens
            got = [_captured(provider, item, ids, i, t) for i, t in zip(at, targets, strict=True)]
        for s, (layers, error) in zip(inside, got, strict=True):
            if error is not None:
                yield {key: item[key], "span_idx": s["span_idx"], "layer": None, "error": error}
            for layer, c in enumerate(layers or ()):
                yield {key: item[key], "span_idx": s["span_idx"], "layer": layer, **{n: c.get(n) for n in names}, "error": None}
        for s in spans:
            if not 0 <= s["response_token_idx"] < len(ids):
                yield {key: item[key], "span_idx": s["span_idx"], "layer": None, "error": f"IndexError: token {s['response_token_idx']} of {len(ids)}"}

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            for item in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(tokens(provider, item)), schema=arrow)

    wanted = rows.where(F.col("response_token_ids").isNotNull() & (F.size("spans") > 0))
    return wanted.mapInArrow(run, schema)


def _captured(provider: CaptureProvider, item: dict, ids: list[int], index: int, target: int) -> tuple[list[dict] | None, str | None]:
    try:
        return provider.capture(item, ids[:index], index, target), None
    except Exception as error:  # noqa: BLE001
        return None, f"{type(error).__name__}: {error}"


def _one(provider: Provider, item: dict) -> tuple[dict | None, str | None]:
    try:
        return provider.generate(item), None
    except Exception as error:  # noqa: BLE001
        return None, f"{type(error).__name__}: {error}"


class Echo:
    """A provider without a model: the item's text in lower case; items without text fail. For tests of the data flow."""

    num_layers, num_visual_tokens = 0, 0

    def __init__(self, config: dict | None = None) -> None:
        self.config = config or {}

    def generate(self, item: dict) -> dict:
        if not item["text"]:
            raise ValueError("no text")
        return {"generated_text": item["text"].lower()}

    def generate_batch(self, items: list[dict]) -> list[dict]:
        return [self.generate(i) for i in items]


register("echo", Echo)
