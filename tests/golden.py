"""Known results the operators are held against."""

# Feature, information about the attack class in nats.
SCORES = {
    "Average Packet Size": 1.12228619202, "Packet Length Mean": 1.12105720318, "Flow IAT Max": 1.06209483168,
    "Fwd IAT Max": 1.06019347992, "Flow Duration": 1.04972404971, "Fwd Header Length61": 1.04857598285,
    "Fwd Header Length40": 1.04841398649, "Packet Length Std": 1.04641207625, "Packet Length Variance": 1.04138282523,
    "Fwd Packets/s": 1.03779256595, "Fwd IAT Total": 1.0259476596, "Fwd IAT Mean": 1.02196584518,
    "Flow IAT Mean": 1.01403001737, "Subflow Bwd Bytes": 0.998101072736, "Total Length of Bwd Packets": 0.998053004545,
    "Bwd Packet Length Mean": 0.990308606923, "Avg Bwd Segment Size": 0.990070048419, "Bwd Header Length": 0.981635182935,
    "Init_Win_bytes_forward": 0.969700986496, "Bwd Packets/s": 0.963336701102, "Init_Win_bytes_backward": 0.944082693467,
    "Max Packet Length": 0.942146686916, "Bwd Packet Length Max": 0.936824629498, "Subflow Fwd Bytes": 0.871773774481,
    "Total Length of Fwd Packets": 0.871545527836, "Fwd Packet Length Max": 0.841808657921,
    "Avg Fwd Segment Size": 0.816241131439, "Fwd Packet Length Mean": 0.815282344372, "Destination Port": 0.793555024621,
    "Total Fwd Packets": 0.791734385304, "Subflow Fwd Packets": 0.79115869776, "min_seg_size_forward": 0.767684344803,
    "Subflow Bwd Packets": 0.749036061922, "Total Backward Packets": 0.74894093071, "Flow IAT Std": 0.743048131593,
    "Fwd IAT Std": 0.694530838587, "Fwd IAT Min": 0.678451302547, "Bwd Packet Length Min": 0.653435737739,
    "Fwd Packet Length Std": 0.635104789724, "Bwd Packet Length Std": 0.606681467519, "Bwd IAT Max": 0.575839983842,
    "Bwd IAT Total": 0.554314880307, "Bwd IAT Mean": 0.54513522815, "Flow IAT Min": 0.528344103,
    "Bwd IAT Std": 0.52619768141, "act_data_pkt_fwd": 0.513422400919, "Idle Mean": 0.484495650462,
    "Idle Min": 0.481122197928, "PSH Flag Count": 0.476817887372, "Idle Max": 0.473527412698,
    "Bwd IAT Min": 0.425762239455, "Source Port": 0.423809835743, "Active Max": 0.37494063974,
    "Active Mean": 0.374731280296, "Active Min": 0.367427863904, "Down/Up Ratio": 0.316471178923,
    "Min Packet Length": 0.305231882997, "Fwd Packet Length Min": 0.299372434997, "ACK Flag Count": 0.280492355547,
    "FIN Flag Count": 0.100172604459, "Idle Std": 0.0820356128001, "Fwd PSH Flags": 0.0491620666019,
    "SYN Flag Count": 0.0489682199684, "Protocol": 0.0385877150205, "URG Flag Count": 0.0361900829759,
    "Active Std": 0.0202799579736, "Fwd Avg Bulk Rate": 0.00117789466517, "ECE Flag Count": 0.000436446571419,
    "Fwd Avg Packets/Bulk": 0.000329012681616, "RST Flag Count": 0.0, "Fwd URG Flags": 0.0, "Fwd Avg Bytes/Bulk": 0.0,
    "CWE Flag Count": 0.0, "Bwd URG Flags": 0.0, "Bwd PSH Flags": 0.0, "Bwd Avg Packets/Bulk": 0.0,
    "Bwd Avg Bytes/Bulk": 0.0, "Bwd Avg Bulk Rate": 0.0,
}
SELECTED_AT_HALF = 46

# Class code: (rows, weight), and the rows of all classes; the classes left out weigh 1.
WEIGHTS_14 = {
    0: (1966, 3.582700529727665), 2: (10293, 1.927237498908217), 4: (5499, 2.554135293926962),
    5: (5796, 2.5015335269942036), 6: (7938, 2.1870401970917657), 7: (11, 8.768561557636406),
    8: (36, 7.582937891978666), 10: (5897, 2.4842578044342725), 11: (1507, 3.848580631808281),
    12: (21, 8.121934392711353), 13: (652, 4.686412268508123),
}
TOTAL_14 = 471454
WEIGHTS_15 = {
    1: (1573, 5.375046163439886), 2: (33468, 2.317441029082675), 3: (8234, 3.719758864168314),
    5: (4399, 4.346653545149445), 6: (4637, 4.293963182106703), 7: (6350, 3.9795759746114268),
    8: (9, 10.538561489161944), 9: (29, 9.36849023651169), 11: (4717, 4.276857783213902),
    12: (1206, 5.640721689211033), 13: (17, 9.902572722441947), 14: (522, 6.478118478615525),
}
TOTAL_15 = 2264594
