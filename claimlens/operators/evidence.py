"""Evidence of predicted and true answers compared item by item, for a whole Arrow batch of rows at once.

Items of all rows of a batch are laid end to end; their parts become numbers, a key is the row with the numbers of its parts, and
rows are counted by masks of items. So nothing is done for each item in Python, and no expression of Spark runs item by item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import RELAXED_IOU, STRICT_IOU

PARTS = ("source_image_id", "source_doc_type", "field", "value")
FOUND = ("support", "value", "source", "strict", "relaxed", "wrong")


def _items(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items, and the row of each."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(*texts: pa.Array) -> list[np.ndarray]:
    """A number for each text, the same for equal ones; null reads as the word None."""
    both = pa.concat_arrays([pc.fill_null(x.cast(pa.string()), "None") for x in texts])
    return np.split(both.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(x) for x in texts])[:-1])


def _keys(rows: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """One number for each row and its parts, different for different ones."""
    out = rows
    for x in parts:
        wide = int(x.max(initial=0)) + 1
        if int(out.max(initial=0)) + 1 > (1 << 62) // wide:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * wide + x
    return out


def _is_in(keys: np.ndarray, other: np.ndarray) -> np.ndarray:
    return pc.is_in(pa.array(keys), value_set=pa.array(other)).to_numpy(zero_copy_only=False)


def _boxes(boxes: pa.Array) -> np.ndarray:
    """n x 4; a coordinate that is null or not there is NaN."""
    begin, n = boxes.offsets.to_numpy()[:-1], pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)
    values = boxes.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(boxes), 4), np.nan)
    for k in range(4):
        some = n > k
        out[some, k] = values[begin[some] + k]
    return out


def matches(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """strict_match and relaxed_match of exprs, for boxes side by side; NaN is their null."""
    span = lambda a, b: np.fmax(0.0, b - a)
    area = lambda b: span(b[:, 0], b[:, 2]) * span(b[:, 1], b[:, 3])
    inter = span(np.fmax(p[:, 0], t[:, 0]), np.fmin(p[:, 2], t[:, 2])) * span(np.fmax(p[:, 1], t[:, 1]), np.fmin(p[:, 3], t[:, 3]))
    union = area(p) + area(t) - inter
    iou = np.where(union <= 0, 0.0, inter / np.where(union <= 0, 1.0, union))
    x, y = (p[:, 0] + p[:, 2]) / 2, (p[:, 1] + p[:, 3]) / 2
    inside = (x >= t[:, 0]) & (x <= t[:, 2]) & (y >= t[:, 1]) & (y <= t[:, 3])
    return iou >= STRICT_IOU, (iou >= RELAXED_IOU) | inside


def compared(true: list[pa.Array], pred: list[pa.Array], images: pa.Array, documents: pa.Array, unsure: pa.Array) -> list[np.ndarray]:
    """FOUND for each row, of lists of PARTS and boxes, of known images with their documents, and of unreadable fields."""
    rows = len(images)
    (t, tr), (p, pr) = ((cols, at[0]) for cols, at in (tuple(zip(*map(_items, x), strict=True)) for x in (true, pred)))
    nt = len(tr)
    known_image, kr = _items(images)
    known_document, _ = _items(documents)
    real = pc.and_(known_image.is_valid(), known_document.is_valid())
    known_image, known_document, kr = known_image.filter(real), known_document.filter(real), kr[real.to_numpy(zero_copy_only=False)]
    unsure_field, ur = _items(unsure)
    some = unsure_field.is_valid()
    unsure_field, ur = unsure_field.filter(some), ur[some.to_numpy(zero_copy_only=False)]

    ti, pi, ki = _numbers(t[0], p[0], known_image)
    td, pd, kd = _numbers(t[1], p[1], known_document)
    tf, pf, uf = _numbers(t[2], p[2], unsure_field)
    tv, pv = _numbers(t[3], p[3])
    row, image, document, field, value = map(np.concatenate, ((tr, pr), (ti, pi), (td, pd), (tf, pf), (tv, pv)))
    whole, sourced, said = _keys(row, image, document, field, value), _keys(row, image, document, field), _keys(row, field, value)
    place = _keys(np.concatenate([pr, kr]), np.concatenate([pi, ki]), np.concatenate([pd, kd]))
    of_field = _keys(np.concatenate([pr, ur]), np.concatenate([pf, uf]))

    count = lambda at, mask: np.bincount(at[mask], minlength=rows).astype(np.int64)
    first = pc.fill_null(pc.index_in(pa.array(whole[:nt]), value_set=pa.array(whole[nt:])), -1).to_numpy(zero_copy_only=False)
    box = np.vstack([_boxes(p[4]), np.full((1, 4), np.nan)])[first]
    strict, relaxed = matches(box, _boxes(t[4]))
    lists = images.is_valid().to_numpy(zero_copy_only=False)
    wrong = ~_is_in(whole[nt:], whole[:nt]) | (~_is_in(place[: len(pr)], place[len(pr) :]) & lists[pr]) | _is_in(of_field[: len(pr)], of_field[len(pr) :])
    again = lambda keys: count(tr, _is_in(keys[:nt], keys[nt:]))
    return [again(whole), again(said), again(sourced), count(tr, strict), count(tr, relaxed), count(pr, wrong)]


def parts(items: Column, name: str) -> dict[str, Column]:
    """The lists of parts and boxes of evidence, as columns."""
    return {**{f"{name}_{k}": items[k].cast("array<string>") for k in PARTS}, f"{name}_bbox": items["bbox"]}


def found(true: str, pred: str, images: str, documents: str, unsure: str) -> Column:
    """struct of FOUND: how many true items are found again, whole, by field and value, by image, document and field, by box strictly
    and loosely; and how many predicted ones are of an unknown image, an unreadable field, or not true.

    true and pred name the columns of parts(). A box is judged on the first prediction with the same four parts.
    """
    lists = [f"{x}_{k}" for x in (true, pred) for k in (*PARTS, "bbox")]

    def count(ti: pa.Array, td: pa.Array, tf: pa.Array, tv: pa.Array, tb: pa.Array, pi: pa.Array, pd: pa.Array, pf: pa.Array, pv: pa.Array, pb: pa.Array, ki: pa.Array, kd: pa.Array, uf: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in compared([ti, td, tf, tv, tb], [pi, pd, pf, pv, pb], ki, kd, uf)], names=list(FOUND))

    udf = F.arrow_udf(count, f"struct<{', '.join(f'{k}: bigint' for k in FOUND)}>")
    return udf(*map(F.col, (*lists, images, documents, unsure)))
