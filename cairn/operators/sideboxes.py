"""TXT-3: contacts, information and ways there from the labelled boxes of a page, where nesting matters."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Titles of the boxes that are told whole, and of the one that lists ways there.
TOLD = ("Contatti del rifugio", "Informazioni utili")
ROUTES = "Accesso al rifugio"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Boxes(HTMLParser):
    """Collects (title, content, ways) of each box."""

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, str]] = []
        self.found: list[tuple[list, list, list]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        part = next((c for c in ("sidebox", "boxtitle", "boxcontent", "approach-data", "hidden-print") if c in classes), "")
        if tag == "a" and any(x in (a.get("href") or "") for x in ("facebook", "instagram")):
            part = "hidden-print"
        if part == "sidebox":
            self.found.append(([], [], []))
        if part == "approach-data" and self.found:
            self.found[-1][2].append([])
        if tag not in VOID:
            self.open.append((tag, part))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        inside = {part for _, part in self.open}
        if "sidebox" not in inside:
            return
        title, content, ways = self.found[-1]
        if "boxtitle" in inside:
            title.append(data)
        elif "boxcontent" in inside:
            if "hidden-print" not in inside:
                content.append(data)
            if "approach-data" in inside:
                ways[-1].append(data)


def told(html: str) -> str:
    """The lines of a page's boxes; ways without a time, or of 00:00, are left out."""
    clean = lambda parts: " ".join("".join(parts).split())
    boxes = Boxes()
    boxes.feed(html)
    out = []
    for title, content, ways in boxes.found:
        if clean(title) in TOLD and clean(content):
            out.append(clean(content))
        elif clean(title) == ROUTES:
            out += [f"Accesso — {t}" for t in map(clean, ways) if "Tempo:" in t and "00:00" not in t]
    return "\n".join(out)


def sideboxes(pages: DataFrame) -> DataFrame:
    """(page_id, told) of pages with page_id and html; a page without boxes tells nothing."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([told(h or "") for h in batch.column(1).to_pylist()], pa.string())], ["page_id", "told"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, told string")
