"""Offline HTML pages: a comparison with filters, and an explorer of one interface. One file, no network, every value escaped.

Each page's only script is allowed by its hash; without it everything can still be read.
"""

from __future__ import annotations

import json
from base64 import b64encode
from hashlib import sha256
from html import escape

from .documents import VERSION, bounded

_STYLE = """
:root{--line:#c9d3de;--soft:#5a6b7f;--accent:#1f5fa8}body{font:15px/1.45 system-ui,sans-serif;margin:0;color:#15202b;background:#f7f9fb}
main{max-width:72rem;margin:auto;padding:2rem 1rem}section,.card{background:#fff;border:1px solid var(--line);border-radius:8px;padding:1rem;margin:1rem 0}
.soft{color:var(--soft)}.tag{border:1px solid var(--line);border-radius:1rem;padding:0 .5rem;margin-left:.4rem;font-size:.8em}.numbers{display:flex;flex-wrap:wrap;gap:1rem}
.numbers div{min-width:8rem}.numbers b{display:block;font-size:1.4em;color:var(--accent)}pre{white-space:pre-wrap;overflow-wrap:anywhere;background:#f1f4f8;padding:.5rem;border-radius:6px;max-height:20rem;overflow:auto}
.sides{display:grid;grid-template-columns:1fr 1fr;gap:1rem}.bar{position:sticky;top:0;background:#f7f9fb;padding:.6rem 0;display:flex;gap:1rem;flex-wrap:wrap}summary{cursor:pointer}[hidden]{display:none!important}
td,th{text-align:left;vertical-align:top;padding:.15rem .6rem .15rem 0}@media(max-width:42rem){.sides{grid-template-columns:1fr}}
"""
_COMPARE = """
const find = id => document.getElementById(id), cards = [...document.querySelectorAll('[data-card]')];
const words = cards.map(c => c.textContent.toLowerCase());
const fits = (row, want) => want === 'all' || [row.dataset.category, row.dataset.scope, row.dataset.way].includes(want);
function show() {
  const text = find('search').value.trim().toLowerCase(), want = find('kind').value, notes = find('notes').checked;
  let n = 0;
  cards.forEach((card, i) => {
    const rows = [...card.querySelectorAll('[data-scope]')];
    rows.forEach(r => { r.hidden = !fits(r, want) || (!notes && r.dataset.category === 'DOCUMENTATION_CHANGE'); });
    card.hidden = rows.every(r => r.hidden) || !words[i].includes(text);
    n += !card.hidden;
  });
  find('shown').textContent = n + ' of ' + cards.length;
}
['search', 'kind', 'notes'].forEach(id => find(id).addEventListener('input', show));
show();
"""
_EXPLORE = """
const cards = [...document.querySelectorAll('[data-search]')], box = document.getElementById('search');
function show() {
  const text = box.value.trim().toLowerCase();
  cards.forEach(c => { c.hidden = !c.dataset.search.includes(text); });
  document.getElementById('shown').textContent = cards.filter(c => !c.hidden).length + ' of ' + cards.length;
}
box.addEventListener('input', show);
show();
"""
#: The sections of the explorer and their entity types.
SECTIONS = (
    ("variables", "Variables", ("status_variable", "data_variable", "equipment_constant")), ("events", "Events", ("collection_event",)), ("reports", "Reports", ("default_report", "event_report_link")), ("alarms", "Alarms", ("alarm",)),
    ("commands", "Commands", ("remote_command", "remote_command_parameter")), ("messages", "Messages and formats", ("supported_message", "variable_format")), ("standards", "Standards and well-known names", ("standard_reference",)),
)


def _h(value) -> str:
    return escape("" if value is None else str(value), quote=True)


def _pretty(value) -> str:
    return f"<pre>{_h(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2))}</pre>"


def _words(name: str) -> str:
    return name.replace("_", " ").lower()


def _page(title: str, body: str, script: str) -> str:
    allowed = b64encode(sha256(script.encode()).digest()).decode()
    policy = f"default-src 'none'; style-src 'unsafe-inline'; script-src 'sha256-{allowed}'; base-uri 'none'; form-action 'none'; connect-src 'none'"
    head = f'<meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{_h(title)}</title><style>{_STYLE}</style>'
    foot = f'<p class="soft">Made locally, version {VERSION}; nothing is loaded from elsewhere.</p>'
    return bounded(f'<!doctype html>\n<html lang="en"><head>{head}</head><body><main><h1>{_h(title)}</h1>{body}{foot}</main><script>{script}</script></body></html>\n')


def _numbers(pairs) -> str:
    return '<div class="numbers">' + "".join(f"<div><b>{_h(n)}</b>{_h(label)}</div>" for label, n in pairs) + "</div>"


def _location(p: dict | None) -> str:
    if not p:
        return "no location"
    line = f"line {p['line']}, column {p['column']}" if p.get("line") else ""
    return " · ".join(_h(x) for x in (p.get("source_document"), p.get("source_path"), line) if x)


def _name(identity: dict | None) -> str | None:
    return next((identity[k] for k in ("name", "implementation_id", "key") if identity and identity.get(k)), None)


def _dependencies(context: dict | None, side: str) -> str:
    if context is None:
        return f"<div><h4>Dependencies in {side}</h4><p>Not there.</p></div>"
    proofs = "".join(f"<li>{_h(_words(d['kind']))}: {_h(_words(d['entity_type']))} {_h(d['entity_key'])} ({len(d['evidence'])})</li>" for d in context["dependencies"])
    left = context["excluded_unresolved_graph_relationships"]
    note = f'<p class="soft">{left} unresolved references are not counted.</p>' if left else ""
    return f"<div><h4>Dependencies in {side}</h4><ul>{''.join(f'<li>{_h(s)}</li>' for s in context['statements'])}</ul>{f'<details><summary>Evidence</summary><ul>{proofs}</ul></details>' if proofs else ''}{note}</div>"


def _change(c: dict) -> str:
    way = "added" if c["change_id"].endswith("_ADDED") and c["scope"] == "entity" else "removed" if c["change_id"].endswith("_REMOVED") and c["scope"] == "entity" else ""
    delta = c["relationship_delta"]
    more = f'<details><summary>Delta</summary><div class="sides"><div>Added{_pretty(delta["added"])}</div><div>Removed{_pretty(delta["removed"])}</div></div><p>order changed: {delta["order_changed"]}, presence changed: {delta["presence_changed"]}</p></details>' if delta else ""
    return (
        f'<div data-scope="{_h(c["scope"])}" data-category="{_h(c["category"])}" data-way="{way}"><h4>{_h(_words(c["field"] or c["scope"]))} <code>{_h(c["change_id"])}</code> <span class="tag">{_h(_words(c["category"]))}</span></h4>'
        f'<div class="sides"><div>Before{_pretty(c["before"])}</div><div>After{_pretty(c["after"])}</div></div>{more}</div>'
    )


def comparison_page(report: dict) -> str:
    """The page of a report document."""
    s = report["summary"]
    key = lambda subject: json.dumps(subject, sort_keys=True)
    context = {key(c["subject"]): c for c in report["dependency_context"]}
    match = {key(m["subject"]): m for m in report["matches"]}
    groups: dict[str, list] = {}
    for c in report["changes"]:
        groups.setdefault(key(c["subject"]), []).append(c)
    cards = []
    order = lambda item: (item[1][0]["subject"]["entity_type"], (item[1][0]["subject"]["source_a"] or {}).get("key") or "", (item[1][0]["subject"]["source_b"] or {}).get("key") or "")
    for k, changes in sorted(groups.items(), key=order):
        subject, found, near = changes[0]["subject"], match.get(k), context.get(k, {})
        a, b = subject["source_a"], subject["source_b"]
        why = f"Matched by {_words(found['strategy'])} ({_words(found['confidence'])}): " + "; ".join(" / ".join(e["identity"]) for e in found["evidence"]) if found else "Only in one version, without doubt." if not (a and b) else "The equipment or the interface itself."
        tags = "".join(f'<span class="tag">{_h(_words(c))}</span>' for c in sorted({c["category"] for c in changes}))
        cards.append(
            f'<details class="card" data-card><summary><strong>{_h(_words(subject["entity_type"]))}: {_h(_name(b) or _name(a) or "unnamed")}</strong> <span class="soft">id {_h((a or {}).get("implementation_id") or "-")} → {_h((b or {}).get("implementation_id") or "-")}</span>'
            f'<span class="tag">{len(changes)}</span>{tags}</summary><p>{_h(why)}</p><div class="sides">{_dependencies(near.get("source_a"), "A")}{_dependencies(near.get("source_b"), "B")}</div>{"".join(map(_change, changes))}</details>'
        )
    nothing = "No semantic changes found." if s["is_complete"] else "No confirmed changes; unresolved items keep the comparison from being complete."
    options = "".join(f'<option value="{v}">{t}</option>' for v, t in (("all", "All changes"), ("added", "Added"), ("removed", "Removed"), ("property", "Properties"), ("relationship", "Relationships"), ("INTERFACE_CHANGE", "Interface"), ("DOCUMENTATION_CHANGE", "Documentation"), ("UNKNOWN_CHANGE", "Unknown")))
    bar = f'<div class="bar"><label>Search <input id="search" type="search"></label><label>Show <select id="kind">{options}</select></label><label><input id="notes" type="checkbox" checked> documentation</label><span id="shown" class="soft" aria-live="polite"></span></div>'
    issues = "".join(f'<div class="card"><strong>{_h(i["issue_code"])}</strong> <span class="soft">source {_h(i["source"].upper())} · {_h(i["entity_type"])} {_h(i["entity_key"])} {_h(i["field"])}</span><p>{_h(i["detail"])}</p>{_pretty(i["identity_ambiguity"]) if i["identity_ambiguity"] else ""}</div>' for i in report["unresolved"])
    told = "".join(f'<div class="card"><strong>{_h(d["code"])}</strong> <span class="soft">{_h(d["severity"])} · source {_h(d["source"].upper())} · {_location(d["provenance"])}</span><p>{_h(d["message"])}</p></div>' for d in report["diagnostics"])
    sources = "".join(f"<div><strong>{n}</strong><br><code>{_h(report[k]['path'])}</code><br>revision {_h(report[k]['revision'])}</div>" for n, k in (("A, before", "source_a"), ("B, after", "source_b")))
    warn = "" if s["is_complete"] else "<section><strong>The comparison is incomplete.</strong> Unresolved items limit what it can say.</section>"
    numbers = _numbers([(_words(k), v) for k, v in s.items() if k != "is_complete"])
    body = f'<section class="sides">{sources}</section>{warn}<section><h2>Summary</h2>{numbers}</section><h2>Changes</h2>{bar}{"".join(cards) or f"<p>{nothing}</p>"}<h2>Unresolved items</h2>{issues or "<p>None.</p>"}<h2>Diagnostics</h2>{told or "<p>None.</p>"}'
    return _page("Interface comparison", body, _COMPARE)


def _label(e: dict) -> str:
    if e["canonical_type"] == "supported_message" and e.get("stream") is not None and e.get("function") is not None:
        return e.get("name") or f"S{e['stream']}F{e['function']}"
    if e["canonical_type"] == "standard_reference":
        return e.get("name") or e.get("designation") or e["key"]
    return e.get("name") or e.get("implementation_id") or e["key"]


def _search(e: dict) -> str:
    terms = [e["key"], e.get("implementation_id"), e.get("name"), e.get("description"), (e.get("wkn") or {}).get("value"), e.get("designation")]
    if e.get("stream") is not None and e.get("function") is not None:
        terms.append(f"S{e['stream']}F{e['function']}")
    return " ".join(t for t in terms if t).lower()


_HIDDEN = {"canonical_type", "key", "owner_key", "name", "description", "implementation_id", "wkn", "provenance", "unknown_extensions", "extension_metadata", "standards"}


def interface_page(model: dict, relationships: list[dict], diagnostics: list[dict], path: str, revision: str) -> str:
    """The page of one canonical document (documents.canonical_json, parsed) with all its relationships and diagnostics."""
    entities = sorted((e for kind in model["entities"].values() for e in kind), key=lambda e: (e["canonical_type"], e.get("implementation_id") or "", e.get("name") or "", e["key"]))
    anchor, by_key = {e["key"]: f"e{i}" for i, e in enumerate(entities)}, {e["key"]: e for e in entities}
    link = lambda key: f'<a href="#{anchor[key]}">{_h(_label(by_key[key]))}</a>'
    into: dict[str, list[str]] = {}
    out: dict[str, list[str]] = {}
    for r in relationships:
        if r["target_key"] in anchor:
            out.setdefault(r["owner_key"], []).append(f"<li>{_h(r['role'])} → {link(r['target_key'])}</li>")
            into.setdefault(r["target_key"], []).append(f"<li>{link(r['owner_key'])} → {_h(r['role'])}</li>")
        else:
            s = r["selector"]
            clue = ", ".join(f"{n} {_h(v)}" for n, v in (("id", s["implementation_id"]), ("name", s["name"]), ("well-known name", (s["wkn"] or {}).get("value"))) if v is not None) or "no selector"
            why = r["reason"] or r["state"]
            out.setdefault(r["owner_key"], []).append(f'<li>{_h(r["role"])} → {clue} <span class="soft">({_h(why)}{f", {len(r["candidate_keys"])} candidates" if r["candidate_keys"] else ""})</span></li>')
    for e in entities:
        if e.get("owner_key") in anchor:
            out.setdefault(e["owner_key"], []).append(f'<li>contains {link(e["key"])}</li>')
            into.setdefault(e["key"], []).append(f"<li>within {link(e['owner_key'])}</li>")
    roles = {r["role"].partition("[")[0] for r in relationships}

    def card(e: dict) -> str:
        rows = "".join(f"<tr><th>{_h(_words(k))}</th><td>{_pretty(v)}</td></tr>" for k, v in sorted(e.items()) if k not in _HIDDEN | roles and v not in (None, [], {}))
        wkn = e.get("wkn")
        name = f'{_h(wkn["value"])} <span class="soft">({_h(wkn["authority_status"])})</span>' if wkn else "none"
        part = lambda title, items: f"<h4>{title}</h4>" + (f"<ul>{''.join(items)}</ul>" if items else "<p>None.</p>")
        where = "; ".join(map(_location, e["provenance"]))
        return (
            f'<details class="card" id="{anchor[e["key"]]}" data-search="{_h(_search(e))}"><summary><strong>{_h(_label(e))}</strong> <span class="tag">{_h(_words(e["canonical_type"]))}</span> <span class="soft">id {_h(e.get("implementation_id") or "none")}</span></summary>'
            f'<p>{_h(e.get("description") or "No description.")}</p><p>Well-known name: {name}</p><table>{rows}</table>{part("Incoming", into.get(e["key"]))}{part("Outgoing", out.get(e["key"]))}<p class="soft">{where}</p></details>'
        )

    sections = []
    for ident, title, kinds in SECTIONS:
        chosen = [e for e in entities if e["canonical_type"] in kinds]
        directory = ""
        if ident == "standards":
            names = sorted((e for e in entities if e.get("wkn")), key=lambda e: (e["wkn"]["value"], e["key"]))
            directory = "<h3>Well-known names</h3>" + (f"<ul>{''.join(f'<li>{_h(e["wkn"]["value"])} → {link(e["key"])}</li>' for e in names)}</ul>" if names else "<p>None.</p>")
        sections.append(f'<section id="{ident}"><h2>{title}</h2><p class="soft">{len(chosen)}</p>{"".join(map(card, chosen)) or "<p>None.</p>"}{directory}</section>')
    q = model["equipment"]
    about = "".join(f"<tr><th>{label}</th><td>{_h(q.get(k) or 'not given')}</td></tr>" for label, k in (("Model", "model"), ("Software revision", "software_revision"), ("Supplier", "supplier"), ("Created", "created_date"), ("Description", "description")))
    numbers = _numbers([("entities", len(entities)), ("references", len(relationships)), ("without a single target", sum(r["state"] != "resolved" for r in relationships))])
    kept = [(e, x) for e in (model["interface"], q, *entities) for x in e.get("unknown_extensions") or []]
    told = "".join(f'<div class="card"><strong>{_h(d["code"])}</strong> <span class="soft">{_h(d["severity"])} · {_location(d["provenance"])}</span><p>{_h(d["message"])}</p></div>' for d in diagnostics)
    told += "".join(f'<div class="card"><strong>kept as it is</strong> <span class="soft">{_h(x["name"])} in {_h(e.get("key") or e["canonical_type"])}</span><p>{_h(x["reason"])}</p></div>' for e, x in kept)
    nav = " · ".join(f'<a href="#{i}">{t}</a>' for i, t, _ in SECTIONS)
    bar = '<div class="bar"><label>Search <input id="search" type="search"></label><span id="shown" class="soft" aria-live="polite"></span></div>'
    body = f'<p><code>{_h(path)}</code> · revision {_h(revision)}</p><nav>{nav} · <a href="#diagnostics">Diagnostics</a></nav><section><h2>Overview</h2>{numbers}<table>{about}</table></section>{bar}{"".join(sections)}<section id="diagnostics"><h2>Diagnostics</h2>{told or "<p>None.</p>"}</section>'
    return _page("Interface", body, _EXPLORE)
