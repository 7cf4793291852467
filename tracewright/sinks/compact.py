"""The compact public JSON of a parsing result: global ids, without what only the parser needs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CROSS_PAGE_KINDS, ENTITY_KINDS

# What the public form leaves out, and what it keeps of a table's cells.
NOT_OF_DIAGRAM, NOT_OF_TABLE = ("elements", "remaining_vectors", "symbols"), ("rows", "columns", "raw_cells")
OF_CELL = ("bbox", "text", "row", "col", "rowspan", "colspan")
NOT_OF_DOCUMENT = ("pages", "crosspage_relations")


def public_form(result: dict, filename: str | None = None) -> dict:
    """A result as one dictionary in its public form."""
    document = {**result.get("document", {}), **({"filename": filename} if filename is not None else {})}
    stem = PurePosixPath(str(document["filename"])).stem
    name = lambda page, kind, local: f"{stem}/p{int(page)}/{kind}/{local}"
    out = {k: v for k, v in result.items() if k not in NOT_OF_DOCUMENT} | {"document": document}
    if isinstance(result.get("symbol_overview"), dict):
        out["symbol_overview"] = {"records": list(result["symbol_overview"].get("records", []))}
    out["pages"] = {key: _page(page, int(key), name) for key, page in result.get("pages", {}).items()}
    return out


def _page(page: dict, number: int, name) -> dict:
    out = {k: v for k, v in page.items() if k != "crosspage_relations"}
    table, diagram = page.get("info_table"), page.get("diagram")
    if isinstance(table, dict):
        cells = [{f: cell.get(f) for f in OF_CELL} | {"bbox": list(cell.get("bbox") or [])} for cell in table.get("cells", [])]
        out["info_table"] = {k: v for k, v in table.items() if k not in NOT_OF_TABLE} | {"cells": cells}
    if isinstance(diagram, dict):
        beside = page.get("crosspage_relations")
        old = {f"{k}s": list(beside[f"{k}s"]) for k in CROSS_PAGE_KINDS if isinstance(beside, dict) and beside.get(f"{k}s")}
        out["diagram"] = _diagram({**old, **diagram}, number, name)
    return out


def _diagram(diagram: dict, page: int, name) -> dict:
    out = {k: v for k, v in diagram.items() if k not in NOT_OF_DIAGRAM}

    def reference(value):
        kind, found, local = str(value).partition(":")
        return name(page, kind, local) if found and kind in ENTITY_KINDS else value

    def component(link: dict, side: str):
        at, own = link.get(f"{side}_page"), link.get(f"{side}_component")
        return None if at is None or own is None else name(at, "component", own)

    rules = {f"{kind}s": lambda i, v, kind=kind: {k: x for k, x in v.items() if k != "elements"} | {"id": name(page, kind, v["id"])} for kind in ENTITY_KINDS}
    rules["relations"] = lambda i, v: {"id": name(page, "relation", i)} | v | {end: reference(v.get(end)) for end in ("source", "target")}
    for kind in CROSS_PAGE_KINDS:
        rules[f"{kind}s"] = lambda i, v, kind=kind: {"id": name(page, kind, i)} | v | {f"{side}_component": component(v, side) for side in ("source", "target")}
    rules["remaining_text"] = lambda i, v: {"id": name(page, "text", i)} | {k: x for k, x in v.items() if k != "text_indices"} | {"nearby": [name(page, "component", c) for c in v.get("nearby", [])]}
    for key, rule in rules.items():
        if isinstance(out.get(key), list):
            out[key] = [rule(i, v) for i, v in enumerate(out[key])]
    return out


def compact_json(results: DataFrame) -> DataFrame:
    """(stem, json) of results as text (result, filename or null): one JSON object for each; a text that is no result ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [public_form(json.loads(text), filename) for text, filename in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            stems = [PurePosixPath(str(x["document"]["filename"])).stem for x in made]
            yield pa.record_batch([pa.array(stems, pa.string()), pa.array([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in made], pa.string())], names=["stem", "json"])

    return results.select("result", F.col("filename").cast("string")).mapInArrow(run, "stem string, json string")


def write_compact(results: DataFrame, path: str) -> None:
    """compact_json as text files, a folder for each stem; those of other stems stay."""
    compact_json(results).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").text(path)
