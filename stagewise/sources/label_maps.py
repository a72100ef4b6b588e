"""Attack label -> stage tables, with the alternative mappings used in sensitivity runs."""

from __future__ import annotations

from dataclasses import dataclass

VARIANTS = ["primary", "conservative", "expanded"]


@dataclass(frozen=True)
class LabelMap:
    benign: tuple[str, ...]
    stages: dict[str, str]
    default: str = "IAD"

    def moved(self, **changes: str) -> "LabelMap":
        """The same table with some labels moved to another stage."""
        unknown = set(changes) - set(self.stages)
        if unknown:
            raise KeyError(f"labels not in the table: {sorted(unknown)}")
        return LabelMap(self.benign, {**self.stages, **changes}, self.default)


# The published mapping of each capture format.
FLOW_MAP = LabelMap(
    benign=("normal",),
    stages={
        "scanning": "IAD",
        "password": "IAD",
        "xss": "IAD",
        "backdoor": "LMEP",
        "injection": "LMEP",
        "mitm": "LMEP",
        "dos": "IMP",
        "ddos": "IMP",
        "ransomware": "IMP",
    },
)

PACKET_MAP = LabelMap(
    benign=("Normal",),
    stages={
        "Fingerprinting": "IAD",
        "Port_Scanning": "IAD",
        "Vulnerability_scanner": "IAD",
        "Password": "IAD",
        "XSS": "IAD",
        "Backdoor": "LMEP",
        "SQL_injection": "LMEP",
        "Uploading": "LMEP",
        "MITM": "LMEP",
        "DDoS_UDP": "IMP",
        "DDoS_ICMP": "IMP",
        "DDoS_TCP": "IMP",
        "DDoS_HTTP": "IMP",
        "Ransomware": "IMP",
    },
)

LABEL_MAPS: dict[str, dict[str, LabelMap]] = {
    "toniot": {
        "primary": FLOW_MAP,
        "conservative": FLOW_MAP.moved(dos="LMEP"),
        "expanded": FLOW_MAP.moved(mitm="IMP"),
    },
    "edgeiiotset": {
        "primary": PACKET_MAP,
        "conservative": PACKET_MAP.moved(DDoS_UDP="LMEP", DDoS_ICMP="LMEP"),
        "expanded": PACKET_MAP.moved(MITM="IMP"),
    },
}
# The event table borrows the flow labels; its variants move labels it really holds.
LABEL_MAPS["events"] = {
    "primary": FLOW_MAP,
    "conservative": FLOW_MAP.moved(ransomware="LMEP"),
    "expanded": FLOW_MAP.moved(backdoor="IMP"),
}
LABEL_MAPS["lineitem"] = LABEL_MAPS["events"]
