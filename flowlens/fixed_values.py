"""Fixed values that results depend on: class names, column names, constants."""

# Class labels.
BENIGN = "BENIGN"
WEB_ATTACK = "Web-Attack"
HEADER_LABEL = " Label"
RAW_ATTACK_LABELS = [
    "Bot",
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS slowloris",
    "FTP-Patator",
    "Heartbleed",
    "Infiltration",
    "PortScan",
    "SSH-Patator",
    "Web Attack - Brute Force",
    "Web Attack - Sql Injection",
    "Web Attack - XSS",
]

# The few columns that tell one attack from the rest.
ATTACK_FEATURES = {
    "DoS slowloris": ["Flow Duration", "Fwd IAT Min", "Bwd IAT Mean", "Fwd IAT Mean"],
    "SSH-Patator": ["Init_Win_bytes_forward", "Subflow Fwd Bytes", "Total Length of Fwd Packets", "ACK Flag Count"],
    "DoS Slowhttptest": ["Flow Duration", "Active Min", "Active Mean", "Flow IAT Std"],
    "FTP-Patator": ["Init_Win_bytes_forward", "Fwd PSH Flags", "SYN Flag Count", "Fwd Packets/s"],
    "Heartbleed": ["Bwd Packet Length Std", "Subflow Fwd Bytes", "Flow Duration", "Total Length of Fwd Packets"],
    "Web-Attack": ["Init_Win_bytes_forward", "Subflow Fwd Bytes", "Init_Win_bytes_backward", "Total Length of Fwd Packets"],
    "DoS Hulk": ["Bwd Packet Length Std", "Flow Duration", "Flow IAT Std"],
    "Infiltration": ["Subflow Fwd Bytes", "Total Length of Fwd Packets", "Flow Duration", "Active Mean"],
    "Bot": ["Subflow Fwd Bytes", "Total Length of Fwd Packets", "Fwd Packet Length Mean", "Bwd Packets/s"],
    "DDoS": ["Bwd Packet Length Std", "Average Packet Size", "Flow Duration", "Flow IAT Std"],
    "PortScan": ["Init_Win_bytes_forward", "Bwd Packets/s", "PSH Flag Count"],
    "DoS GoldenEye": ["Bwd Packet Length Std", "Flow IAT Min", "Fwd IAT Min", "Flow IAT Mean"],
}
BENIGN_FEATURES = ["Bwd Packet Length Min", "Subflow Fwd Bytes", "Total Length of Fwd Packets", "Fwd Packet Length Mean"]

# Share of benign rows kept when thinning, and the class-weight damping factor.
BENIGN_KEEP_FRACTION = 471454 / 2647898
CLASS_WEIGHT_MU = 0.15

# Hidden layer widths of the networks.
CLASSIFIER_WIDTHS = [100, 100, 100]
AUTOENCODER_WIDTHS = [18, 13, 8, 3]
AUTOENCODER_CODE = 2
AUTOENCODER_SWEEP = {
    "model25": [25, 20, 15, 10, 5],
    "model30": [30, 24, 18, 12, 6],
    "model26": [26, 20, 14, 8],
    "model28": [28, 24, 20, 16, 8],
}
