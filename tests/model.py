"""A document of our own with every entity kind and one of each relation."""

from strataweave.plans.synthetic import document, element, text


def refs(container: str, tag: str, *ids: str) -> str:
    return element(container, *(text(tag, i) for i in ids))


def machine(name: str = "Pressure", unit: str = "Pa", low: str = "0", report: tuple = ("1", "2", "1"), note: str = "Chamber pressure", event: str = "10", default: str = "5", required: str = "Yes", items: str = "<m:ASC/><m:UI4/>", revision: str = "E99", extra: str = "", clear: str = "11", group_note: str = "as shipped") -> bytes:
    """Every argument is one thing that a later version may change."""
    status = element("StatusVariable", text("SVID", "1"), text("SVNAME", name), text("Description", note), text("WellKnownName", "ChamberPressure"), text("SEMIStandard", "SEMI E30"), text("Format", "F4"), text("UNITS", unit), text("MinValue", low), text("MaxValue", "100"))
    data = element("DataVariable", text("VID", "2"), text("DVVALNAME", "Lot"), text("Description", "Lot id"), text("Format", "F4"))
    constant = element("EquipmentConstant", text("ECID", "3"), text("ECNAME", "Timeout"), text("Description", "s"), text("ECMIN", "1"), text("ECMAX", "9"), text("ECDEF", default))
    start = element("CollectionEvent", text("CEID", "10"), text("CENAME", "Start"), text("Description", "started"), element("StateTransition", text("StateModel", "run"), text("TransitionID", "1"), text("PreviousState", "idle"), text("NewState", "busy")))
    stop = element("CollectionEvent", text("CEID", "11"), text("CENAME", "Stop"), text("Description", "stopped"))
    alarm = element("Alarm", text("ALID", "7"), text("AlarmName", "Hot"), text("Description", "too hot"), text("ALCD", "-3"), text("ALTX", "HOT"), text("SetEvent", "10"), text("ClearEvent", clear))
    shape = element("SECSData", element("m:LST", items, dataItemName="X", description="inner"))
    formats = element("VariableFormat", text("FormatName", "F4"), element("SECSData", "<m:FP4/>"))
    command = element("RemoteCommand", text("Name", "GO"), text("Documentation", "starts"), element("AssociatedParameters", element("Parameter", text("Name", "LOT"), text("Description", "lot"), element("ValueFormat", "<m:ASC maxLength='8'/>"), IsRequired=required), element("Parameter", text("Name", "SLOT"), text("Description", "slot"), IsRequired="No")), text("ObjectSpecifier", "*"), useS2F41="true", useS2F21="0")
    message = element("m:SECSMessage", text("m:Description", "hello"), text("m:Header", "h"), text("m:Exception", "none"), shape.replace("SECSData", "m:SECSData"), name="S1F1", s="01", f="1", direction="H to E", mnenomic="R", replyBit="1", replyOption="required", blocking="S")
    requirement = element("Requirement", text("Name", "Q"), text("Section", "1"), text("Section", "2"), text("RequirementID", "r1"), text("Implemented", "true"), text("Compliant", "Yes"), text("Note", group_note))
    standard = element("SupportedSEMIStandard", text("SEMIStandardName", "SEMI E30"), text("SEMIStandard", revision), element("RequirementGroup", text("Name", "G"), requirement), text("Note", "n"))
    sections = {
        "StatusVariables": status, "DataVariables": data, "EquipmentConstants": constant, "CollectionEvents": start + stop, "Alarms": alarm, "VariableFormats": formats, "RemoteCommands": command, "SECSMessages": message,
        "DefaultReportDefinitions": text("CanBeDeleted", "true") + element("DefaultReportDefinition", text("RPTID", "5"), text("DefaultReportName", "R"), text("Description", "r"), refs("VIDList", "VID", *report)),
        "DefaultEventReportLinks": text("CanBeDeleted", "0") + element("EventReportLink", text("CEID", event), refs("RPTIDList", "RPTID", "5"), text("Description", "l")), "SEMIStandards": standard,
    }
    return document(sections, "<EquipmentID>eq</EquipmentID><MDLN>M</MDLN><SOFTREV>1</SOFTREV><Supplier>s</Supplier><CreateDate>today</CreateDate><Description>d</Description>", extra=extra)
