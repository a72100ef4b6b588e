"""Source specifications: which columns of a raw table mean what.

A spec names *candidates*; what a table really holds is decided against its header.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from stagewise.functions import timecols


@dataclass(frozen=True)
class SourceSpec:
    name: str
    timestamp: tuple[str, ...]
    asset: tuple[str, ...]
    peer: tuple[str, ...] = ()
    binary_label: tuple[str, ...] = ()
    attack_type: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    time_format: str = "auto"
    # The time text may lack its calendar date; gate windowing on the share that has one.
    date_gated: bool = False
    record_id: str | None = None
    preferred_filename: str | None = None
    file_glob: str = "*.csv"
    # Extension points: both return Columns, so nothing runs row by row in Python.
    parse_timestamp: Callable[[Column], Column] | None = None
    quality_checks: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def timestamp_column(self, raw: Column) -> Column:
        if self.parse_timestamp is not None:
            return self.parse_timestamp(raw)
        if self.time_format == "epoch_seconds":
            return timecols.from_epoch_text(raw)
        if self.time_format == "ntz":
            return raw.cast("timestamp_ntz")
        return timecols.from_free_text(raw)


# Column candidates of the two published capture formats.
FLOW = SourceSpec(
    name="toniot",
    timestamp=("ts", "timestamp", "time"),
    asset=("src_ip", "id.orig_h", "source_ip"),
    peer=("dst_ip", "id.resp_h", "destination_ip"),
    binary_label=("label",),
    attack_type=("type",),
    time_format="epoch_seconds",
    preferred_filename="Train_Test_Network.csv",
    numeric=(
        "duration", "src_bytes", "dst_bytes", "missed_bytes", "src_pkts", "src_ip_bytes", "dst_pkts",
        "dst_ip_bytes", "http_request_body_len", "http_response_body_len", "http_status_code",
        "dns_qclass", "dns_qtype", "dns_rcode",
    ),
    categorical=(
        "proto", "service", "conn_state", "dns_AA", "dns_RD", "dns_RA", "dns_rejected", "ssl_version",
        "ssl_resumed", "ssl_established", "http_method", "http_version", "weird_name", "weird_notice",
    ),
    drop=(
        "ssl_subject", "ssl_issuer", "http_uri", "http_referrer", "http_user_agent",
        "http_orig_mime_types", "http_resp_mime_types", "dns_query", "weird_addl",
    ),
)

PACKET = SourceSpec(
    name="edgeiiotset",
    timestamp=("frame.time", "frame_time", "timestamp"),
    asset=("ip.src_host", "ip_src_host", "src_ip"),
    peer=("ip.dst_host", "ip_dst_host", "dst_ip"),
    binary_label=("Attack_label", "attack_label"),
    attack_type=("Attack_type", "attack_type"),
    time_format="auto",
    date_gated=True,
    preferred_filename="ML-EdgeIIoT-dataset.csv",
    numeric=(
        "arp.opcode", "arp.hw.size", "icmp.checksum", "icmp.seq_le", "icmp.unused", "http.content_length",
        "http.response", "tcp.ack", "tcp.checksum", "tcp.connection.fin", "tcp.connection.rst",
        "tcp.connection.syn", "tcp.connection.synack", "tcp.flags", "tcp.flags.ack", "tcp.len", "tcp.seq",
        "udp.stream", "udp.time_delta", "dns.qry.name.len", "dns.qry.qu", "dns.qry.type",
        "dns.retransmission", "mqtt.conack.flags", "mqtt.conflag.cleansess", "mqtt.len", "mqtt.msgtype",
        "mqtt.proto_len", "mqtt.topic_len", "mqtt.ver", "mbtcp.len", "mbtcp.trans_id", "mbtcp.unit_id",
    ),
    categorical=(
        "http.request.method", "http.request.version", "http.tls_port", "mqtt.hdrflags",
        "mqtt.msg_decoded_as", "mqtt.protoname", "dns.qry.name",
    ),
    drop=(
        "http.file_data", "http.request.uri.query", "http.referer", "http.request.full_uri", "tcp.options",
        "tcp.payload", "mqtt.msg", "mqtt.topic", "arp.dst.proto_ipv4", "arp.src.proto_ipv4",
        "icmp.transmit_timestamp", "dns.retransmit_request", "dns.retransmit_request_in",
    ),
)

# The generic event table, see `stagewise.sources.readers.read_events`.
EVENTS = SourceSpec(
    name="events",
    timestamp=("ts",),
    asset=("user_id",),
    peer=("peer",),
    attack_type=("attack_type",),
    numeric=("value",),
    categorical=("event_type",),
    time_format="ntz",
    record_id="event_id",
)

# Line items seen as supplier -> part traffic: the large-fan-out case.
LINEITEMS = SourceSpec(
    name="lineitem",
    timestamp=("l_shipdate",),
    asset=("l_suppkey",),
    peer=("l_partkey",),
    attack_type=("attack_type",),
    numeric=("l_quantity", "l_extendedprice"),
    categorical=("l_returnflag", "l_linestatus"),
    time_format="ntz",
)

SOURCES = {s.name: s for s in (FLOW, PACKET, EVENTS, LINEITEMS)}
