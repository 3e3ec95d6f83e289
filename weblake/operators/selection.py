"""Arrow batches of pages and their selectors → what the selectors take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weblake.functions.selectors import Page, compile_selector
from weblake.operators import treepass

FOUND = pa.map_(pa.string(), pa.list_(pa.string()))


def _page(nodes, attr_offsets, names, values, start, stop):
    """The :class:`Page` of the nodes from ``start`` to ``stop`` of a batch; ``nodes`` are columns as arrays."""
    elem = nodes["elem"][start:stop]
    places, parents = nodes["ord"][start:stop], nodes["parent_no"][start:stop]
    spots = (np.flatnonzero(elem) + start).tolist()
    attrs = [dict(zip(names[attr_offsets[i]:attr_offsets[i + 1]], values[attr_offsets[i]:attr_offsets[i + 1]])) for i in spots]
    texts = (np.flatnonzero(~elem) + start).tolist()
    return Page(parents[elem].tolist(), [nodes["tag"][i] for i in spots], attrs, parents[~elem].tolist(),
                [nodes["text"][i] for i in texts], places[elem].tolist() + places[~elem].tolist())


def found_arrays(batches, fields):
    """Batches whose last columns are ``wanted`` (a selector or null a field) and ``nodes`` → the same with
    ``found`` (field → values) in their place."""
    for batch in batches:
        wanted, lists = (batch.column(batch.num_columns - k) for k in (2, 1))
        flat = lists.flatten()
        columns = {f: flat.field(f) for f in ("ord", "elem", "parent_no", "tag", "text", "attrs")}
        nodes = {f: columns[f].to_numpy(zero_copy_only=False) for f in ("ord", "elem", "parent_no")}
        nodes |= {f: columns[f].to_pylist() for f in ("tag", "text")}
        nodes["elem"] = nodes["elem"].astype(bool)
        attrs = columns["attrs"]
        attr_offsets = (attrs.offsets.to_numpy() - (attrs.offsets[0].as_py() if len(attrs.offsets) else 0)).tolist()
        first = attrs.offsets[0].as_py() if len(attrs.offsets) else 0
        names, values = (side.slice(first).to_pylist() for side in (attrs.keys, attrs.items))
        offsets = (lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)).tolist()
        out = []
        for row, selectors in enumerate(wanted.to_pylist()):
            rules = [(f, s) for f, s in zip(fields, selectors or ()) if s]
            page = _page(nodes, attr_offsets, names, values, offsets[row], offsets[row + 1]) if rules else None
            out.append(_taken(page, fields, selectors) if rules else [])
        kept = batch.select(list(range(batch.num_columns - 2)))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, FOUND)], names=[*kept.schema.names, "found"])


def _taken(page, fields, selectors):
    return [(f, page.take(compile_selector(s)[0] or [])) for f, s in zip(fields, selectors or ()) if s]


def _page_of_rows(rows):
    """The :class:`Page` of the rows of ``treepass.page_rows``."""
    elements, texts = [r for r in rows if r[1] == "elem"], [r for r in rows if r[1] == "text"]
    return Page([r[3] for r in elements], [r[5] for r in elements], [r[6] for r in elements], [r[3] for r in texts],
                [r[7] for r in texts], [r[0] for r in elements] + [r[0] for r in texts])


def page_arrays(batches, fields, with_nodes):
    """Batches whose last columns are ``wanted`` and ``tokens`` → the same with ``found``, and before it ``nodes`` if
    asked for, in their place: a page is parsed and its selectors run in one pass."""
    for batch in batches:
        wanted, tokens = (batch.column(batch.num_columns - k) for k in (2, 1))
        head = batch.select(list(range(batch.num_columns - 2)))
        wanted = wanted.to_pylist()
        done, pages, found, size = 0, [], [], 0
        for i in range(batch.num_rows):
            rows = treepass.page_rows(tokens[i].as_py() or (), None)
            found.append(_taken(_page_of_rows(rows), fields, wanted[i]) if any(wanted[i] or ()) else [])
            pages.append(rows if with_nodes else [])
            size += len(rows) + sum(len(row[7] or "") for row in rows) // treepass.CHARS_A_NODE if with_nodes else 0
            if size >= treepass.BATCH_NODES or i == batch.num_rows - 1:
                if with_nodes:
                    out = treepass._batch(head, done, pages)
                else:
                    out = head.slice(done, len(found))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, FOUND)], names=[*out.schema.names, "found"])
                done, pages, found, size = i + 1, [], [], 0
