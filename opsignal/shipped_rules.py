"""Detection rules, field names and log sources as data.

Fixed values: fields, values, event ids and expressions must be those of the shipped rules for results to be the same.
`lines`: what is looked for in log lines where a source has no fields; it then stands for the selections.
"""

LINUX_PROCESS = {"category": "process_creation", "product": "linux"}
LINUX_NETWORK = {"category": "network_connection", "product": "linux"}
WINDOWS_SECURITY = {"product": "windows", "service": "security"}
WINDOWS_SYSTEM = {"product": "windows", "service": "system"}
WINDOWS_PROCESS = {"product": "windows", "category": "process_creation"}
HYPERV = {"product": "windows", "service": "microsoft-windows-hyper-v-worker-admin"}

#: Attributes that a record of a log source has.
LOG_SOURCES = [
    (WINDOWS_SECURITY, {"log.source": "windows-security"}),
    (WINDOWS_SYSTEM, {"log.source": "windows-system"}),
    (WINDOWS_PROCESS, {"log.source": "sysmon"}),
    (HYPERV, {"log.source": "hyperv"}),
]

#: Rule field -> key in a record's fields, where they differ.
FIELD_NAMES = {"DestinationPort": "DestPort", "DestinationIp": "DestIp"}

RULES = [
    {
        "id": "c2-callback", "title": "Potential C2 Callback from Container", "level": "high",
        "tags": ["attack.command_and_control", "attack.t1071", "attack.t1105"], "logsource": LINUX_NETWORK,
        "detection": {
            "selection_reverse_shell": {
                "Image|endswith": ["/nc", "/ncat", "/netcat", "/bash", "/sh", "/python", "/python3", "/perl", "/ruby"],
                "DestinationPort": [4444, 4445, 1337, 31337, 9001],
            },
            "condition": "selection_reverse_shell",
        },
        "lines": {
            "event_class": ["runtime-security"],
            "all": ["Redirect STDOUT/STDIN to Network Connection", "rport=(4444|4445|1337|31337|9001)[^0-9]"],
        },
    },
    {
        "id": "container-shell", "title": "Interactive Shell Spawned in Container", "level": "high",
        "tags": ["attack.execution", "attack.t1059.004", "attack.t1609"], "logsource": LINUX_PROCESS,
        "detection": {
            "selection": {"Image|endswith": ["/sh", "/bash", "/zsh", "/dash", "/fish"], "ContainerName|contains": "*"},
            "condition": "selection",
        },
        "lines": {"event_class": ["runtime-security"], "all": ["Terminal shell in container"]},
    },
    {
        "id": "crypto-miner", "title": "Crypto Miner Process Detected", "level": "critical",
        "tags": ["attack.impact", "attack.t1496"], "logsource": LINUX_PROCESS,
        "detection": {
            "selection_binary": {
                "Image|endswith": ["/xmrig", "/minerd", "/cpuminer", "/ethminer", "/claymore", "/nbminer"],
                "CommandLine|contains": ["stratum+", "pool.minexmr", "xmrpool", "moneropool", "--donate-level", "-o stratum"],
            },
            "condition": "selection_binary",
        },
        "lines": {
            "event_class": ["application", "auth"],
            "all": ["xmrig|minerd|cpuminer|ethminer|nbminer|stratum\\+|pool\\.minexmr|xmrpool|moneropool|--donate-level"],
            "none": ["executeQuery|TCPHandler|DB::Exception"],
        },
    },
    {
        "id": "privilege-escalation", "title": "Privilege Escalation via Setuid Binary or Capability Change", "level": "high",
        "tags": ["attack.privilege_escalation", "attack.t1548.001", "attack.t1548.003"], "logsource": LINUX_PROCESS,
        "detection": {
            "selection_setuid": {"Image|endswith": ["/sudo", "/su", "/newgrp", "/pkexec", "/doas"], "ContainerName|contains": "*"},
            "selection_capability_tools": {
                "Image|endswith": ["/setcap", "/getcap", "/capsh"],
                "CommandLine|contains": ["cap_setuid", "cap_net_admin", "cap_sys_admin", "cap_dac_override"],
            },
            "condition": "selection_setuid or selection_capability_tools",
        },
        "lines": {"event_class": ["runtime-security"], "all": ["cap_setuid|cap_sys_admin|cap_net_admin|cap_dac_override|setcap|capsh"]},
    },
    {
        "id": "windows_defender_disabled", "title": "Windows Defender Disabled", "level": "high",
        "tags": ["attack.defense_evasion", "attack.t1562.001"], "logsource": WINDOWS_SECURITY,
        "detection": {"selection": {"EventID": 4689, "ProcessName|endswith": "\\MsMpEng.exe"}, "condition": "selection"},
    },
    {
        "id": "windows_audit_policy_changed", "title": "Security Audit Policy Changed", "level": "high",
        "tags": ["attack.defense_evasion", "attack.t1562.002"], "logsource": WINDOWS_SECURITY,
        "detection": {"selection": {"EventID": 4719}, "condition": "selection"},
    },
    {
        "id": "hyperv_vm_unexpected_shutdown", "title": "Hyper-V VM Unexpected Shutdown", "level": "high",
        "tags": ["availability"], "logsource": HYPERV,
        "detection": {"selection": {"EventID": [18590, 18570]}, "condition": "selection"},
    },
    {
        "id": "hyperv_migration_failure", "title": "Hyper-V Live Migration Failure", "level": "medium",
        "tags": ["availability"], "logsource": HYPERV,
        "detection": {"selection": {"EventID": 21502}, "condition": "selection"},
    },
    {
        "id": "windows_psexec", "title": "PsExec Remote Execution", "level": "high",
        "tags": ["attack.lateral_movement", "attack.t1570"], "logsource": WINDOWS_SYSTEM,
        "detection": {"selection": {"EventID": 7045, "ServiceName|contains": "PSEXESVC"}, "condition": "selection"},
    },
    {
        "id": "windows_wmi_remote", "title": "WMI Remote Process Creation", "level": "medium",
        "tags": ["attack.lateral_movement", "attack.t1021.006"], "logsource": WINDOWS_PROCESS,
        "detection": {
            "selection": {
                "ParentProcessName|endswith": "\\WmiPrvSE.exe",
                "Image|endswith": ["\\cmd.exe", "\\powershell.exe", "\\wscript.exe", "\\cscript.exe"],
            },
            "condition": "selection",
        },
    },
    {
        "id": "windows_scheduled_task_creation", "title": "Suspicious Scheduled Task Creation", "level": "medium",
        "tags": ["attack.persistence", "attack.t1053.005"], "logsource": WINDOWS_SECURITY,
        "detection": {
            "selection": {"EventID": 4698}, "filter_system": {"SubjectUserName|endswith": "$"}, "condition": "selection and not filter_system",
        },
    },
    {
        # known services: any log collector's and the virus scanner's
        "id": "windows_new_service", "title": "New Service Installation", "level": "low",
        "tags": ["attack.persistence", "attack.t1543.003"], "logsource": WINDOWS_SYSTEM,
        "detection": {
            "selection": {"EventID": 7045}, "filter_known": {"ServiceName|contains": ["otelcol", "WinDefend"]},
            "condition": "selection and not filter_known",
        },
    },
]
