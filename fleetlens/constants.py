"""Limits, catalogues and texts that results must carry unchanged."""

# Detector limits (strictly greater than).
DETECTOR_LIMITS = {
    "cpu_usage": 80.0,
    "memory_usage": 85.0,
    "disk_usage": 90.0,
    "network_latency": 200.0,
}

# One threshold detector per metric.
# metric, anomaly type, critical above, severity otherwise, text before the value, text after it, action
THRESHOLD_DETECTORS = [
    ("cpu_usage", "cpu_threshold_breach", 95.0, "high", "CPU usage ", "% exceeds threshold", "identify_cpu_intensive_processes"),
    ("memory_usage", "memory_threshold_breach", 95.0, "high", "Memory usage ", "% exceeds threshold", "free_memory_resources"),
    ("disk_usage", "disk_threshold_breach", 98.0, "high", "Disk usage ", "% exceeds threshold", "cleanup_disk_space"),
    ("network_latency", "network_latency_high", None, "medium", "Network latency ", "ms exceeds threshold", "check_network_connectivity"),
]

# Remediation catalogue (type, actions, scripts, priority) and its default.
REMEDIATION_CATALOGUE = [
    ("cpu_threshold_breach", ["kill_high_cpu_processes", "restart_services", "scale_horizontally"],
     ["kill_top_cpu_process.sh", "restart_critical_services.sh"], "high"),
    ("memory_threshold_breach", ["clear_cache", "restart_memory_intensive_services", "enable_swap"],
     ["clear_system_cache.sh", "restart_services.sh"], "high"),
    ("disk_threshold_breach", ["cleanup_temp_files", "rotate_logs", "compress_old_files"],
     ["disk_cleanup.sh", "log_rotation.sh"], "critical"),
    ("network_latency_high", ["restart_network_services", "flush_dns_cache", "check_firewall_rules"],
     ["network_reset.sh", "dns_flush.sh"], "medium"),
    ("memory_leak_pattern", ["restart_suspected_services", "dump_memory_analysis", "enable_memory_monitoring"],
     ["restart_leaky_services.sh", "memory_dump.sh"], "high"),
]
DEFAULT_ACTIONS = ["manual_investigation"]
DEFAULT_PRIORITY = "low"

# Issue type -> script key.
ISSUE_SCRIPTS = [
    ("cpu_threshold_breach", "kill_high_cpu_process"),
    ("memory_threshold_breach", "clear_cache"),
    ("disk_threshold_breach", "cleanup_disk_space"),
    ("network_latency_high", "network_reset"),
]

# Fixed values: (script key, operating system) -> script path.
SCRIPT_PATHS = [
    ("kill_high_cpu_process", "linux", "scripts/linux/kill_high_cpu.sh"),
    ("cleanup_disk_space", "linux", "scripts/linux/disk_cleanup.sh"),
    ("restart_services", "linux", "scripts/linux/restart_services.sh"),
    ("clear_cache", "linux", "scripts/linux/clear_cache.sh"),
    ("network_reset", "linux", "scripts/linux/network_reset.sh"),
    ("kill_high_cpu_process", "windows", "scripts/windows/kill_high_cpu.bat"),
    ("cleanup_disk_space", "windows", "scripts/windows/disk_cleanup.bat"),
    ("restart_services", "windows", "scripts/windows/restart_services.bat"),
    ("clear_cache", "windows", "scripts/windows/clear_cache.bat"),
    ("network_reset", "windows", "scripts/windows/network_reset.bat"),
]

# Alert rules (rule, metric, threshold, seconds it must hold, severity).
ALERT_RULES = [
    ("cpu_high", "cpu_usage", 80.0, 300, "warning"),
    ("cpu_critical", "cpu_usage", 95.0, 60, "critical"),
    ("memory_high", "memory_usage", 85.0, 300, "warning"),
    ("memory_critical", "memory_usage", 95.0, 60, "critical"),
    ("disk_critical", "disk_usage", 90.0, 0, "critical"),
]

# Notification channels for critical alerts.
NOTIFICATION_CHANNELS = ["webhook", "email", "slack"]

# Gauge limits (metric, warning, critical), reached at >=.
GAUGE_LIMITS = [
    ("cpu_usage", 80.0, 95.0),
    ("memory_usage", 85.0, 95.0),
    ("disk_usage", 90.0, 98.0),
    ("network_latency", 100.0, 200.0),
]

# Health check per component
# (component, metric, critical above, critical penalty, warning above, warning penalty,
#  critical issue text, impact text, warning issue text).
HEALTH_CHECKS = [
    ("cpu", "cpu_usage", 95.0, 30, 80.0, 10,
     "Critical CPU usage", "System may become unresponsive", "High CPU usage"),
    ("memory", "memory_usage", 95.0, 25, 85.0, 10,
     "Critical memory usage", "Risk of out-of-memory errors", "High memory usage"),
    ("disk", "disk_usage", 98.0, 35, 90.0, 15,
     "Critical disk usage", "System may fail to write data", "High disk usage"),
]

# Recommendations from the latest snapshot (metric, above, category, priority, text).
RECOMMENDATIONS = [
    ("cpu_usage", 80.0, "CPU Optimization", "High",
     "CPU usage is consistently high. Consider load balancing or upgrading CPU."),
    ("memory_usage", 85.0, "Memory Management", "High",
     "Memory usage is high. Review running processes and consider increasing RAM."),
    ("disk_usage", 90.0, "Storage", "Critical",
     "Disk space is critically low. Clean up unnecessary files or expand storage."),
]

# Insight texts (metric, change above, insight, recommendation).
INSIGHTS = [
    ("cpu", 10.0, "CPU usage has increased significantly in recent measurements",
     "Consider investigating processes causing increased CPU usage"),
    ("memory", 8.0, "Memory usage shows concerning upward trend", "Monitor for potential memory leaks"),
]

# Short-term predictions of the dashboard (type, probability, time estimate, recommendation).
CPU_OVERLOAD = ("CPU Overload", "High", "2-4 hours",
                "Consider scaling up CPU resources or optimizing running processes")
MEMORY_LEAK = ("Memory Leak", "Medium", "6-12 hours",
               "Investigate memory-intensive processes and consider restart")

# Averages above these read "Above normal".
NORMAL_LIMITS = {"cpu_usage": 70.0, "memory_usage": 75.0, "disk_usage": 80.0}

# Phrases that mark a script as dangerous.
BLOCKED_PHRASES = ["rm -rf", "del /f", "format"]

# Severity ordinals and message types.
SEVERITY_LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
REPLY_TYPES = ["pong", "remediation_result", "script_result", "config_updated"]
COMMAND_TYPES = ["restart", "remediate", "update_config", "run_script", "ping"]

# Forests (trees, trailing rows, history must exceed, contamination, severity high below).
SYSTEM_FOREST = {"trees": 100, "window": 50, "contamination": 0.1, "high_below": -0.5}
NETWORK_FOREST = {"trees": 50, "window": 30, "contamination": 0.05, "high_below": -0.3}

# What the forests find (type, description, action).
SYSTEM_ANOMALY = ("system_anomaly", "Unusual system behavior detected by ML model", "investigate_system_resources")
NETWORK_ANOMALY = ("network_anomaly", "Unusual network behavior detected", "check_network_connectivity")

# Seconds between two snapshots of an agent.
SNAPSHOT_INTERVAL_S = 30
