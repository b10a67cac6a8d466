"""KML placemarks: nested folders, shared styles and style maps, geometries flattened."""
from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, pos int, type string, rings array<array<struct<lat:double,lng:double>>>, name string, description string, icon_url string, icon_scale double, line_color string, line_width double, fill_color string, filled boolean, outlined boolean"


def color(text: str | None) -> str | None:
    """aabbggrr -> #rrggbbaa."""
    t = (text or "").strip().lower()
    return f"#{t[6:8]}{t[4:6]}{t[2:4]}{t[0:2]}" if len(t) == 8 else None


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _child(e, name: str):
    return next((c for c in e if _tag(c) == name), None) if e is not None else None


def _text(e, name: str) -> str | None:
    c = _child(e, name)
    return c.text.strip() if c is not None and c.text else None


def _style(e) -> dict:
    icon, line, poly = _child(e, "IconStyle"), _child(e, "LineStyle"), _child(e, "PolyStyle")
    flag = lambda p, n: (_text(p, n) or "1") != "0"
    return {"icon_url": _text(_child(icon, "Icon"), "href"), "icon_scale": float(_text(icon, "scale") or 1), "line_color": color(_text(line, "color")), "line_width": float(_text(line, "width") or 1), "fill_color": color(_text(poly, "color")), "filled": flag(poly, "fill"), "outlined": flag(poly, "outline")}


def _positions(e) -> list[tuple[float, float]]:
    out = []
    for p in (_text(e, "coordinates") or "").split():
        v = p.split(",")
        if len(v) >= 2:
            out.append((float(v[1]), float(v[0])))
    return out


def _ring(e) -> list[tuple[float, float]]:
    ps = _positions(_child(e, "LinearRing"))
    return ps[:-1] if len(ps) > 1 and ps[0] == ps[-1] else ps


def _geometries(e, holes: bool):
    kind = _tag(e)
    if kind == "MultiGeometry":
        for c in e:
            yield from _geometries(c, holes)
    elif kind in ("Point", "LineString"):
        ps = _positions(e)
        if ps:
            yield kind, [ps]
    elif kind == "Polygon":
        outer = _ring(_child(e, "outerBoundaryIs"))
        if len(outer) >= 3:
            inner = [_ring(c) for c in e if _tag(c) == "innerBoundaryIs"] if holes else []
            yield kind, [outer, *(r for r in inner if len(r) >= 3)]


def read_document(text: str, holes: bool = True) -> list[dict]:
    """One dict for each geometry.  Style: inline, else by styleUrl, through a map's normal entry."""
    root = ET.fromstring(text)
    styles = {e.get("id"): _style(e) for e in root.iter() if _tag(e) == "Style" and e.get("id")}
    for e in root.iter():
        if _tag(e) == "StyleMap" and e.get("id"):
            for pair in e:
                if _text(pair, "key") == "normal":
                    inline = _child(pair, "Style")
                    styles[e.get("id")] = _style(inline) if inline is not None else styles.get((_text(pair, "styleUrl") or "").lstrip("#"))
    out = []
    for mark in root.iter():
        if _tag(mark) != "Placemark":
            continue
        inline = _child(mark, "Style")
        style = _style(inline) if inline is not None else styles.get((_text(mark, "styleUrl") or "").rpartition("#")[2])
        style = style or _style(None)
        for g in mark:
            for kind, rings in _geometries(g, holes):
                out.append({"type": kind, "rings": rings, "name": _text(mark, "name"), "description": _text(mark, "description"), **style})
    return out


def flatten(docs: DataFrame, holes: bool = True) -> DataFrame:
    """SCHEMA rows of documents (doc_id, doc)."""
    names = [f.split(" ")[0] for f in ("doc_id", "pos", "type", "rings", "name", "description", "icon_url", "icon_scale", "line_color", "line_width", "fill_color", "filled", "outlined")]

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf.doc_id, pdf.doc):
                for pos, r in enumerate(read_document(text, holes)):
                    rows.append({**r, "doc_id": i, "pos": pos, "rings": [[{"lat": a, "lng": b} for a, b in ring] for ring in r["rings"]]})
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "doc").mapInPandas(run, SCHEMA)
