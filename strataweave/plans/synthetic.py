"""Documents made to measure, for tests and benches."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from ..sources.dictionary import NAMESPACE, SMN
from ..sources.xml import XSI

SECTIONS = ("CollectionEvents", "DataVariables", "EquipmentConstants", "Alarms", "VariableFormats", "StatusVariables")


def element(tag: str, *content: str, **attributes: str) -> str:
    """An element of text and elements that are text already; see text()."""
    attrs = "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items())
    return f"<{tag}{attrs}>{''.join(content)}</{tag}>"


def text(tag: str, value: str) -> str:
    return element(tag, escape(value))


def document(sections: dict[str, str] | None = None, header: str = "<MDLN>M</MDLN><SOFTREV>1</SOFTREV>", location: str | None = "E172-0225-SEDD-Schema.xsd", extra: str = "") -> bytes:
    """A whole document; sections that are required but not given are empty."""
    sections = {s: "" for s in SECTIONS} | (sections or {})
    hint = f' xsi:schemaLocation="{NAMESPACE} {location}"' if location else ""
    body = "".join(element(s, c) for s, c in sections.items())
    return f'<s:DataDictionary xmlns:s="{NAMESPACE}" xmlns:m="{SMN}" xmlns:xsi="{XSI}"{hint}><SEDDHeader>{header}</SEDDHeader>{body}{extra}</s:DataDictionary>'.encode()


def measured(variables: int, references: int, description: int = 32, items: int = 0, name: str = "Variable") -> bytes:
    """`variables` status variables, one report that refers to them `references` times, and a message of `items` items."""
    status = "".join(element("StatusVariable", text("SVID", str(i)), text("SVNAME", f"{name} {i}"), text("Description", "d" * description)) for i in range(variables))
    report = element("DefaultReportDefinition", text("RPTID", "1"), text("DefaultReportName", "all"), element("VIDList", *(text("VID", str(i % variables)) for i in range(references))))
    sections = {"StatusVariables": status, "DefaultReportDefinitions": report}
    if items:
        sections["SECSMessages"] = element("m:SECSMessage", element("m:SECSData", element("m:LST", "<m:UI4/>" * items)), s="99", f="1", direction="H to E")
    return document(sections)
