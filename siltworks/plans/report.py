"""Report sinks: JSON, Markdown, HTML, and a summary for the console. What they show is limited; the tables aren't."""

from __future__ import annotations

import datetime as dt
import html
import json
import os
import re
import uuid

from pyspark.sql import functions as F

from ..functions.paths import format_bytes_py

EXACT_SHOWN, NEAR_SHOWN = 50, 20
FORMATS = {"json": "json", "markdown": "md", "html": "html"}
STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em}.keep{background:#e6f4ea}.high{color:#b00020}.medium{color:#c77700}.low{color:#1a7f37}"


def plain(value):
    """A value as JSON has it; dates in ISO 8601, UTC."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z"
    return value


def default_name(kind: str, root: str, now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now(dt.timezone.utc)
    return f"dedupe-report-{os.path.basename(root.rstrip('/'))}-{now:%Y-%m-%dT%H-%M-%S}.{FORMATS[kind]}"


def escape_markdown(text: str) -> str:
    return re.sub(r"([\\`*_{}\[\]()#+\-.!|])", r"\\\1", text)


def escape_html(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def similarity_class(value: float) -> str:
    return "high" if value >= 0.95 else "medium" if value >= 0.85 else "low"


def share(part: float, whole: float) -> str:
    return f"{part / whole * 100:.2f}%" if whole else "0.00%"


def to_json(data: dict) -> str:
    return json.dumps(plain(data), indent=2, ensure_ascii=False)


def json_parts(data: dict, tables: dict):
    """The pieces of data's JSON text, with all groups of the tables (`exact`, `near`) instead of those that are in data. Groups come from
    the executors a partition at a time."""
    mark, lists, whole = uuid.uuid4().hex, {}, dict(data)

    def instead(key, table):
        lists[key] = table
        return f"{mark}{key}"

    if "exact" in tables and data.get("exact"):
        whole["exact"] = {**data["exact"], "groups": instead("exact", tables["exact"])}
    if "near" in tables and data.get("near"):
        whole["near"] = {k: instead(k, tables["near"].where(F.col("type") == k).drop("number")) for k in data["near"]}
    text, *rest = to_json(whole).split(f'"{mark}')
    yield text
    for piece in rest:
        key, after = piece.split('"', 1)
        yield "["
        for k, row in enumerate(lists[key].toLocalIterator()):
            yield ("," if k else "") + "\n" + json.dumps(plain(row.asDict(recursive=True)), ensure_ascii=False)
        yield "]" + after


def sections(data: dict):
    """(title, facts, table heads, rows, note) of each part of a report; a row may begin with a mark."""
    scan = data["scan"]
    facts = [("Folders", ", ".join(scan["roots"])), ("Files", f"{scan['total_files']:,}"), ("Size", format_bytes_py(scan["total_size"])), ("Scan time", f"{scan['scan_time']} ms")]
    if index := scan.get("index_stats"):
        facts.append(("Index hits", f"{index['hit_rate'] * 100:.2f}% ({index['hit_count']} hits, {index['miss_count']} misses)"))
    rows = [(None, e["extension"], f"{e['n_files']:,}", format_bytes_py(e["total_size"]), share(e["total_size"], scan["total_size"])) for e in scan["extensions"]]
    yield "Files by extension", facts, ("Extension", "Files", "Size", "Share"), rows, ""
    if exact := data.get("exact"):
        s = exact["summary"]
        facts = [("Groups", f"{s['n_groups']:,}"), ("Files in groups", f"{s['total_duplicate_files']:,}"), ("Wasted", format_bytes_py(s["total_wasted_space"])), ("Across folders", format_bytes_py(s["cross_directory_wasted_space"])), ("Within a folder", format_bytes_py(s["intra_directory_wasted_space"]))]
        yield "Exact duplicates", facts, (), [], ""
        for k, g in enumerate(exact["groups"][:EXACT_SHOWN], 1):
            keep = g.get("keep_path") or g["files"][0]["path"]
            rows = [("keep" if f["path"] == keep else None, f["path"], os.path.basename(f.get("source_root") or "") or "-", str(plain(f["mtime"])), "keep" if f["path"] == keep else "delete") for f in g["files"]]
            note = f"{s['n_groups'] - EXACT_SHOWN} more groups" if k == EXACT_SHOWN and s["n_groups"] > EXACT_SHOWN else ""
            across = ", across folders" if g["is_cross_directory"] else ""
            yield f"Group {k}: {format_bytes_py(g['wasted_space'])}{across}", [("Hash", g["content_hash"]), ("Size", format_bytes_py(g["size"]))], ("Path", "Folder", "Modified", "Action"), rows, note
    for kind, groups in (data.get("near") or {}).items():
        n = data.get("near_totals", {}).get(kind, len(groups))
        yield f"Near duplicates: {kind}", [("Groups", f"{n:,}")], (), [], ""
        for k, g in enumerate(groups[:NEAR_SHOWN], 1):
            rows = [(similarity_class(f["similarity"]), f["path"], os.path.basename(f.get("source_root") or "") or "-", f"{f['similarity'] * 100:.2f}%") for f in g["files"]]
            note = f"{n - NEAR_SHOWN} more groups" if k == NEAR_SHOWN and n > NEAR_SHOWN else ""
            yield f"{g['id']}: {g['avg_similarity'] * 100:.2f}%", [], ("Path", "Folder", "Similarity"), rows, note
    if cleanup := data.get("cleanup"):
        yield "Cleanup" + (" (dry run)" if cleanup["dry_run"] else ""), [("Rule", cleanup["rule"]), ("Deleted", f"{cleanup['deleted_count']:,}"), ("Recovered", format_bytes_py(cleanup["recovered_space"]))], (), [], ""


def to_markdown(data: dict) -> str:
    out = ["# Duplicates", "", f"- **Made**: {plain(data['generated_at'])}", ""]
    for title, facts, heads, rows, note in sections(data):
        out += [f"## {escape_markdown(title)}", ""] + [f"- **{k}**: {v}" for k, v in facts] + [""] * bool(facts)
        if rows:
            out += ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)] + ["| " + " | ".join(escape_markdown(str(c)) for c in row) + " |" for _, *row in rows] + [""]
        if note:
            out += [f"> {note}", ""]
    return "\n".join(out)


def to_html(data: dict) -> str:
    out = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Duplicates</title>", f"<style>{STYLE}</style></head><body><h1>Duplicates</h1>", f"<p>Made {plain(data['generated_at'])}</p>"]
    for title, facts, heads, rows, note in sections(data):
        out.append(f"<h2>{escape_html(title)}</h2>")
        if facts:
            out.append("<ul>" + "".join(f"<li><b>{escape_html(k)}</b>: {escape_html(str(v))}</li>" for k, v in facts) + "</ul>")
        if rows:
            body = "".join(f"<tr class='{mark or ''}'>" + "".join(f"<td>{escape_html(str(c))}</td>" for c in row) + "</tr>" for mark, *row in rows)
            out.append("<table><tr>" + "".join(f"<th>{escape_html(h)}</th>" for h in heads) + f"</tr>{body}</table>")
        if note:
            out.append(f"<p>{escape_html(note)}</p>")
    return "\n".join([*out, "</body></html>"])


def export(data: dict, kind: str, path: str, tables: dict | None = None) -> str:
    """Writes a report, with the folders above it; returns the path. A JSON report has all groups of the tables, if they are given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    parts = json_parts(data, tables or {}) if kind == "json" else [{"markdown": to_markdown, "html": to_html}[kind](data)]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts)
    return path


def console(data: dict) -> str:
    """Ten extensions with bars, five exact groups and two near groups with three files each, five errors."""
    scan, out = data["scan"], []
    out.append(f"{scan['total_files']:,} files, {format_bytes_py(scan['total_size'])}")
    for e in scan["extensions"][:10]:
        part = e["total_size"] / scan["total_size"] if scan["total_size"] else 0
        out.append(f"  {e['extension']:<16}{e['n_files']:>8}{format_bytes_py(e['total_size']):>12}{part * 100:6.1f}% {'#' * round(part * 20)}")
    if exact := data.get("exact"):
        out.append(f"{exact['summary']['n_groups']} exact groups, {format_bytes_py(exact['summary']['total_wasted_space'])} wasted")
        for g in exact["groups"][:5]:
            out += [f"  {g['content_hash'][:12]} x{g['n_files']} {format_bytes_py(g['wasted_space'])}"] + [f"    {f['path']}" for f in g["files"][:3]]
    for kind, groups in (data.get("near") or {}).items():
        out.append(f"{data.get('near_totals', {}).get(kind, len(groups))} near groups of {kind}")
        for g in groups[:2]:
            out += [f"  {g['id']}"] + [f"    {f['path']}" for f in g["files"][:3]]
    if cleanup := data.get("cleanup"):
        out.append(f"{'would delete' if cleanup['dry_run'] else 'deleted'} {cleanup['deleted_count']} files, {format_bytes_py(cleanup['recovered_space'])}")
        out += [f"  {e}" for e in cleanup["errors"][:5]]
    return "\n".join(out)
