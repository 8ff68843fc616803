"""Changing files beside photos: sidecar texts and moves, a group of files as one unit of work.

Each task writes under a temporary name and renames, so a task that runs again leaves the same files.  Paths are URIs that
pyarrow.fs understands, on storage that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame


def _at(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _there(uri: str) -> bool:
    fs, path = _at(uri)
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def write_sidecars(rows: DataFrame, create_only: bool = False) -> DataFrame:
    """(photo, sidecar, status) for rows (photo, sidecar, text): written, updated, skipped (there, and create_only) or missing (no photo)."""

    def one(photo: str, sidecar: str, text: str) -> str:
        if not _there(photo):
            return "missing"
        before = _there(sidecar)
        if before and create_only:
            return "skipped"
        fs, path = _at(sidecar)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(part) as out:
            out.write(text.encode())
        fs.move(part, path)
        return "updated" if before else "written"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["photo", "sidecar"]].assign(status=[one(*r) for r in zip(pdf["photo"], pdf["sidecar"], pdf["text"], strict=True)])

    return rows.select("photo", "sidecar", "text").mapInPandas(run, "photo string, sidecar string, status string")


def free_name(uri: str, taken: set[str]) -> str:
    """The name itself, or the first of name_dup1, name_dup2, ... that no file has."""
    head, dot, ext = uri.rpartition(".")
    n, name = 0, uri
    while name in taken or _there(name):
        n += 1
        name = f"{head}_dup{n}{dot}{ext}"
    taken.add(name)
    return name


def move_groups(plan: DataFrame) -> DataFrame:
    """(grp, src, dst, moved) for rows (grp, src, dst): all files of a group move, or none.  Taken names get _dupN.

    If a move fails the group's earlier ones are moved back.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src", ignore_index=True)
        done: list[tuple[str, str]] = []
        taken: set[str] = set()
        try:
            for src, dst in zip(pdf["src"], pdf["dst"], strict=True):
                fs, path = _at(src)
                if not _there(src):
                    raise FileNotFoundError(src)
                target = free_name(dst, taken)
                at = _at(target)[1]
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                fs.move(path, at)
                done.append((src, target))
        except OSError:
            for src, target in reversed(done):
                _at(src)[0].move(_at(target)[1], _at(src)[1])
            return pdf.assign(moved=False)
        return pdf.assign(dst=[t for _, t in done], moved=True)

    return plan.select("grp", "src", "dst").groupBy("grp").applyInPandas(one, f"grp {dict(plan.dtypes)['grp']}, src string, dst string, moved boolean")
