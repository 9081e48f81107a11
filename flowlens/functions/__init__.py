from flowlens.functions.labels import attack_group, binary_target, normalize_label
from flowlens.functions.network import ips_from_flow_id, pick, risk_flags, synthetic_ip
from flowlens.functions.times import epoch_bucket, floor_window, millis_between, parse_iso, recent
from flowlens.functions.values import finite, is_numeric_text, key_hash, masked_argmax, safe_ratio, to_number
