"""The rules that come with the engine."""

from __future__ import annotations

from .model import Compound, Heuristic, RulePack, Signature, StormRule

# Event types, patterns, severities and thresholds of the store's log, in match order.
_STORE = (
    Signature("slow_fdatasync", "slow_fdatasync", "high", (r'"msg"\s*:\s*"slow fdatasync"', r"slow fdatasync"), family="storage_timing"),
    Signature("readindex_retry", "readindex_retry", "medium", (r"waiting for ReadIndex response took too long",), family="read_path"),
    Signature("linearizable_read_slow", "linearizable_read_slow", "medium", (r'"msg"\s*:\s*"trace\[.*\]\s+linearizableReadLoop"', r"\blinearizableReadLoop\b"), family="read_path"),
    Signature("raft_read_agreement_slow", "raft_read_agreement_slow", "medium", (r"agreement among raft nodes before linearized reading",), family="read_path"),
    Signature("raft_heartbeat_miss", "raft_heartbeat_miss", "high", (r"leader failed to send out heartbeat on time",), family="storage_timing"),
    Signature("apply_took_too_long", "apply_took_too_long", "medium", (r"apply request took too long",), family="apply_path"),
    Signature("raft_process_slow", "raft_process_slow", "low", (r"'process raft request'\s*\(duration:",), family="apply_path"),
    Signature("raft_compare_slow", "raft_compare_slow", "low", (r"'compare'\s*\(duration:",), family="apply_path"),
    Signature("inmemory_index_scan_slow", "inmemory_index_scan_slow", "low", (r"range keys from in-memory index tree",), family="apply_path"),
    Signature("applied_index_lag", "applied_index_lag", "high", (r"appliedIndex\s+is\s+now\s+lower\s+than\s+readState\.Index",), family="apply_path"),
    Signature("context_deadline", "context_deadline", "medium", (r"context deadline exceeded",), family="client_network"),
    Signature("context_canceled", "context_canceled", "medium", (r"context canceled",), family="client_network"),
    Signature("grpc_transport_closing", "grpc_transport_closing", "high", (r"transport is closing",), family="client_network"),
    Signature("peer_probe_unhealthy", "peer_probe_unhealthy", "critical", (r"prober detected unhealthy status",), family="raft_election"),
    Signature("peer_connect_refused", "peer_connect_refused", "critical", (r"connect:\s*connection refused",), family="raft_election"),
    Signature("health_no_leader", "health_no_leader", "critical", (r"serving\s+/health\s+false;\s+no leader", r"RAFT NO LEADER", r"/health error"), family="raft_election"),
    Signature("health_registry_read", "health_registry_read", "low", (r'key:"/registry/health"',), family="read_path"),
    Signature("raft_election", "raft_election", "critical", (r"starting a new election", r"became pre-candidate", r"elected leader", r"became follower", r"higher term"), family="raft_election"),
    Signature("client_conn_rejected", "client_conn_rejected", "high", (r"rejected connection on client endpoint",), family="client_network"),
    Signature("client_conn_reset", "client_conn_reset", "low", (r"connection reset by peer", r"\bEOF\b"), family="client_network"),
    Signature("rpc_request_stats", "rpc_request_stats", "medium", (r'"msg"\s*:\s*"request stats"', r"\brequest stats\b")),
)
_SLOW = (100.0, 300.0, 750.0, 1500.0)
_HEALTH = (100.0, 150.0, 250.0, 500.0)
# Thresholds in milliseconds for low, medium, high and critical; storms; combined findings.
_POLICIES = {
    "slow_fdatasync": (200.0, 500.0, 2000.0, 5000.0),
    "raft_heartbeat_miss": (50.0, 100.0, 250.0, 1000.0),
    "apply_took_too_long": _SLOW,
    "linearizable_read_slow": _SLOW,
    "raft_read_agreement_slow": _SLOW,
    "rpc_request_stats": _SLOW,
    "raft_process_slow": _SLOW,
    "raft_compare_slow": _SLOW,
    "health_registry_read": _HEALTH,
}
_STORMS = (
    StormRule("readindex_retry", 30, 5, "high"),
    StormRule("apply_took_too_long", 60, 20, "high"),
    StormRule("linearizable_read_slow", 60, 20, "high"),
    StormRule("raft_heartbeat_miss", 30, 3, "critical"),
    StormRule("slow_fdatasync", 60, 3, "critical"),
    StormRule("context_deadline", 60, 10, "high"),
    StormRule("applied_index_lag", 60, 5, "critical"),
)
_COMPOUNDS = (
    Compound("likely_storage_stall_cascade", "high", 300, ("slow_fdatasync", "raft_heartbeat_miss"), ("apply_took_too_long", "readindex_retry", "linearizable_read_slow")),
    Compound("likely_leader_overload", "high", 300, ("readindex_retry", "linearizable_read_slow"), (), ("slow_fdatasync",)),
    Compound("likely_peer_connectivity_failure", "critical", 600, (), ("peer_connect_refused", "peer_probe_unhealthy")),
    Compound("likely_client_visible_outage", "high", 300, thresholds=(("context_deadline", 5),)),
)
STORE = RulePack("store", _STORE, _STORMS, _POLICIES, (("/registry/health", _HEALTH),), compounds=_COMPOUNDS)

# Signals of the daemon's journal, in match order; ``also`` must match as well or the line is no signal.
JOURNAL = RulePack(
    "journal",
    (
        Signature("swarm_no_leader", "swarm_no_leader", "critical", (r"swarm does not have a leader",), family="raft_election"),
        Signature("deadline_exceeded", "deadline_exceeded", "high", (r"DeadlineExceeded", r"context deadline exceeded")),
        Signature("no_route_to_host", "no_route_to_host", "high", (r"no route to host",), family="client_network"),
        Signature("connection_refused", "connection_refused", "high", (r"connection refused",), family="client_network"),
        Signature("dns_no_such_host", "dns_no_such_host", "medium", (r"lookup .* no such host",), family="client_network"),
        Signature("memberlist_refuting", "memberlist_refuting", "medium", (r"memberlist:.*Refuting",)),
        Signature("networkdb_connectivity_issues", "networkdb_connectivity_issues", "medium", (r"NetworkDB stats.*healthscore",), family="client_network"),
        Signature("agent_session_failed", "agent_session_failed", "high", (r"agent: session failed",), family="raft_election"),
        Signature("etcd_rpc_unavailable", "etcd_rpc_unavailable", "high", (r'logger":"etcd-client"', r'"logger"\s*:\s*"etcd-client"'), family="client_network", also=r"rpc error|Unavailable|EOF"),
        Signature("grpc_transport_closing", "grpc_transport_closing", "medium", (r"transport is closing",)),
    ),
)

_IP = r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"
# Signatures of host logs; a line may match several, in this order.
HOST = RulePack(
    "host",
    (
        Signature("docker_systemd_stop", "docker_restart", "high", (r"systemd\[1\]: Stopping Docker",), "docker_daemon", 0.90, manager_only=True, pre=2, post=3),
        Signature("docker_systemd_start", "docker_restart", "medium", (r"systemd\[1\]: Started Docker",), "docker_daemon", 0.85, manager_only=True),
        Signature("dockerd_sigterm", "docker_sigterm", "high", (r"dockerd.*received signal.*terminated",), "docker_daemon", 0.95, manager_only=True),
        Signature("docker_leftover_iptables", "docker_cleanup_warning", "medium", (r"docker\.service: Found left-over process.*iptables",), "docker_daemon", 0.70, post=1),
        Signature("raft_leadership_lost", "raft_leadership_loss", "critical", (r"(?i)(lost leader|no leader)",), "raft", 0.95, (2377,), manager_only=True, pre=2, post=5),
        Signature(
            "raft_leadership_lost_generic",
            "raft_leadership_loss",
            "critical",
            (r"(?i)leadership (lost|was lost|has been lost)", r"(?i)lost (the )?leader", r"(?i)no (current )?leader", r"(?i)leader (went away|has changed|changed)", r"(?i)became (candidate|follower)", r"(?i)starting a new election", r"(?i)election tick"),
            "raft",
            0.85,
            (2377,),
            manager_only=True,
            pre=2,
            post=6,
        ),
        Signature("swarm_controlplane_leader_generic", "swarm_leader_change", "high", (r"(?i)manager.*(leader|leadership)", r"(?i)dispatcher.*(leader|leadership)", r"(?i)raft.*(leader|leadership)", r"(?i)swarm.*(leader|leadership)"), "swarm", 0.80, (2377,), manager_only=True, pre=2, post=6),
        Signature("raft_new_election", "raft_election", "high", (r"starting a new election",), "raft", 0.90, (2377,), manager_only=True, pre=2, post=5),
        Signature("raft_became_leader", "raft_leadership_gained", "info", (r"became leader",), "raft", 0.85, (2377,), manager_only=True, post=3),
        Signature(
            "raft_peer_connect_error",
            "raft_peer_connect_error",
            "high",
            (r"dial tcp .*:2377.*(i/o timeout|connection refused|context deadline exceeded)",),
            "raft",
            0.90,
            (2377,),
            (("peer", _IP), ("port", r"(2377)"), ("reason", r"(i/o timeout|connection refused|context deadline exceeded)")),
            True,
            post=3,
        ),
        Signature("memberlist_timeout", "memberlist_timeout", "high", (r"memberlist:.*:7946.*i/o timeout", r"memberlist:.*no acks received"), "memberlist", 0.85, (7946,), (("peer", _IP), ("port", r"(7946)")), True),
        Signature("memberlist_suspect", "memberlist_suspect", "medium", (r"memberlist: Suspect",), "memberlist", 0.80, (7946,), manager_only=True),
        Signature("oom_killer", "oom_event", "critical", (r"Out of memory", r"Killed process", r"oom-killer"), "host", 0.90, post=3),
        Signature("disk_full", "disk_full", "high", (r"No space left on device", r"ENOSPC"), "host", 0.85),
        Signature("time_step", "time_step", "medium", (r"Time has been changed", r"System clock.*changed", r"stepped time"), "host", 0.70),
    ),
    heuristics=(
        Heuristic("swarm_leader_churn", (("swarm_leader_change", 3),), 900, 0.85, supports=("raft_election", "raft_peer_connect_error")),
        Heuristic("swarm_gossip_instability", (("memberlist_timeout", 5),), 600, 0.80, supports=("memberlist_suspect",)),
        Heuristic("repeated_elections", (("raft_election", 2),), 900, 0.85, supports=("raft_leadership_loss", "raft_peer_connect_error")),
        Heuristic("docker_restart_storm", (("docker_restart", 3),), 600, 0.90, supports=("docker_sigterm",)),
        Heuristic("leadership_loss_present", (("raft_leadership_loss", 1),), 1800, 0.95, "critical", ("raft_election", "memberlist_timeout")),
    ),
    chatty=("memberlist_timeout", "raft_peer_connect_error"),
)

# Patterns whose hits are counted by file and day. Braces that mean themselves are escaped.
PATTERNS = (
    r"left gossip cluster",
    r"healthscore:[2-9] \(connectivity issues\)",
    r'with result "error:context canceled" took too long',
    r"unsynchronized systime with swarm",
    r"the clock difference against peer .* is too high",
    r"has prevented the request from succeeding \(get secrets\)",
    r"level.*error.* Cannot connect to the Docker daemon at tcp:",
    r"Error from leadership election follower",
    r"Cluster leadership lost",
    r"heartbeat to manager .* failed",
    r"dispatcher is stopped",
    r"cni config uninitialized",
    r'level=error msg="periodic bulk sync failure for network',
    r'": rejected connection from .* tcp "',
    r"memberlist: Failed fallback ping: read tcp .* read: connection reset by peer",
    r"memberlist: Marking .* as failed, suspect timeout reached",
    r"but other probes failed, network may be misconfigured",
    r"Some RethinkDB data on this server has been placed into swap",
    r"is in state down: heartbeat failure for node in",
    r"is in state down: Unhealthy UCP manager: ERROR: RethinkDB Health check timed out",
    r"is in state down: Awaiting healthy status in classic node inventory - current status: Unhealthy",
    r"etcd cluster is unavailable or misconfigured",
    r"martian source",
    r"Failed to execute iptables-[rs].* segmentation fault",
    r"Failed to create existing container",
    r"failed to allocate network IP for task",
    r"Failed to allocate address: Invalid address space",
    r"Failed to delegate: Failed to allocate address: No available addresses",
    r"fatal task error.*starting container failed: Address already in use",
    r"deleteServiceInfoFromCluster NetworkDB DeleteEntry failed for",
    r"Failed to start certificate controller: error reading CA cert file",
    r"Failed to load config file",
    r"failed to re-resolve dtr-rethinkdb-",
    r"unable to query [dD][bB]: rethinkdb",
    r"unable to create event in database: rethinkdb: Cannot perform write:",
    r"unable to create job: unable to insert job into db: rethinkdb: Cannot perform write:",
    r"RethinkDB Health check timed out",
    r"failed to complete security handshake from",
    r'Err :connection error: desc = "transport: authentication handshake failed: read tcp',
    r"http: TLS handshake error from .* tls: client didn't provide a certificate",
    r"tls: failed to verify client's certificate: x509: certificate has expired or is not yet valid",
    r"level=error .* x509: certificate signed by unknown authority",
    r"error.* x509: certificate has expired or is not yet valid: current time",
    r': rejected connection from .* tls: .* certificate", ServerName',
    r": rejected connection from .* tls: .* certificate: x509: certificate has",
    r': rejected connection from .* "tls: .* does not match any of DNSNames',
    r'OOMKilled":true',
    r"invoked oom-killer",
    r"[Cc]onnection refused",
    r"HTTP error: Unable to reach primary cluster manager",
    r"nfs: server  not responding, still trying",
    r":53: no such host",
    r"port .* is already in use",
    r"bind: address already in use",
    r"No installed keys could decrypt the message",
    r"[Nn]o space left on device",
    r"cannot allocate memory",
    r"error detaching from network .*: could not find network attachment for container .* to network",
    r'FieldPath:"spec.containers\{calico-node\}"\}, Reason:"Unhealthy", Message:"Liveness probe failed:',
    r'FieldPath:"spec.containers\{calico-node\}"\}, Reason:"Unhealthy", Message:"Readiness probe failed:',
    r"Unable to route request",
    r"Legacy license failure",
    r'level=error msg="agent: session failed" backoff=.* error="rpc error: code = Unavailable desc = all SubConns are in TransientFailure',
    r'"level":"fatal"',
    r"LOG_LEVEL=debug",
    r"OVERLAP on Network",
    r"iptables: Resource temporarily unavailable",
    r"unable to look up Node Feature Discovery",
)
# Prefixes of keys that are counted apart; globs of files that are scanned and left out; read limits.
KEY_PREFIXES = ("/registry/health", "/registry/leases/", "/registry/events/", "/registry/minions/", "/registry/configmaps/", "/registry/pods/", "/registry/namespaces/", "/registry/services/")
INCLUDE = ("var/log/docker*", "var/log/containerd*", "var/log/messages*", "var/log/syslog*", "var/log/daemon.log*", "var/log/kern.log*", "sos_commands/logs/journalctl*", "sos_commands/systemd/systemctl*", "sos_commands/kernel/dmesg*", "sos_commands/docker/*", "sos_strings/logs/journalctl*.tailed", "var/log/installer/syslog*")
EXCLUDE = ("**/*.gz", "**/*.xz", "**/*.bz2", "**/*.zip", "**/var/log/journal/**", "**/*.journal", "**/core*", "**/*.core")
MOST_FILE_BYTES, MOST_BYTES, MOST_FILES = 104_857_600, 536_870_912, 5_000
