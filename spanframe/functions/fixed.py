"""Word lists, weights, limits and presets that results must reproduce."""

HIGHLIGHT_TYPES = [
    "confrontation", "counterattack", "action", "dialogue", "performance", "emotion", "reveal",
    "suspense", "comedy", "spectacle", "character_definition", "relationship_shift", "moral_choice",
]
DEFAULT_TYPE = "character_definition"
MUST_HEAR_TYPES = ["dialogue", "performance", "action", "emotion", "reveal", "comedy"]

TYPE_ALIASES = {
    "冲突": "confrontation", "训斥": "confrontation", "羞辱": "confrontation", "摊牌": "confrontation",
    "反击": "counterattack", "打脸": "counterattack", "回怼": "counterattack",
    "动作": "action", "打斗": "action", "追逐": "action",
    "台词": "dialogue", "表演": "performance", "微表情": "performance", "情绪": "emotion",
    "反转": "reveal", "揭示": "reveal", "悬念": "suspense", "喜剧": "comedy", "笑点": "comedy",
    "视觉奇观": "spectacle", "人物塑造": "character_definition", "关系变化": "relationship_shift", "道德选择": "moral_choice",
    "conflict": "confrontation", "humiliation": "confrontation", "insult": "confrontation",
    "fight": "action", "chase": "action", "line": "dialogue", "acting": "performance",
    "microexpression": "performance", "emotional": "emotion", "twist": "reveal", "reversal": "reveal",
    "thrill": "suspense", "visual": "spectacle", "relationship": "relationship_shift",
}

BASE_WEIGHTS = {
    "story_significance": 0.14, "immediate_intensity": 0.10, "performance_value": 0.10, "dialogue_value": 0.07,
    "visual_value": 0.07, "action_value": 0.07, "emotion_value": 0.08, "reveal_value": 0.07, "suspense_value": 0.06,
    "comedy_value": 0.04, "relationship_shift": 0.06, "state_change_strength": 0.07, "context_independence": 0.04,
    "genre_fit": 0.02, "novelty": 0.01,
}
GENRE_MULTIPLIERS = {
    "action": {"action_value": 1.7, "visual_value": 1.35, "immediate_intensity": 1.25, "dialogue_value": 0.7},
    "suspense": {"suspense_value": 1.7, "reveal_value": 1.45, "state_change_strength": 1.25, "action_value": 0.8},
    "drama": {"performance_value": 1.55, "dialogue_value": 1.2, "emotion_value": 1.35, "relationship_shift": 1.35},
    "romance": {"performance_value": 1.45, "emotion_value": 1.55, "relationship_shift": 1.45, "immediate_intensity": 0.8},
    "comedy": {"comedy_value": 2.1, "dialogue_value": 1.2, "performance_value": 1.2, "story_significance": 0.8},
}
RISK_WEIGHTS = {"spoiler": 0.06, "context_dependency": 0.08, "redundancy": 0.10, "unsafe_boundary": 0.15}
SCORE_ALIASES = {
    "immediate_intensity": ["drama", "intensity", "tension"],
    "performance_value": ["performance", "acting"],
    "dialogue_value": ["dialogue", "line"],
    "visual_value": ["visual", "spectacle"],
    "action_value": ["action", "motion"],
    "emotion_value": ["emotion"],
    "reveal_value": ["reveal", "twist"],
    "suspense_value": ["suspense"],
    "comedy_value": ["comedy", "humor"],
    "relationship_shift": ["relationship", "relationship_shift"],
    "state_change_strength": ["state_change", "change"],
}
FALLBACK_HINTS = [  # type, score field, threshold, must hear the original
    ("action", "action_value", 0.60, False),
    ("performance", "performance_value", 0.58, True),
    ("dialogue", "dialogue_value", 0.62, True),
    ("reveal", "reveal_value", 0.60, True),
    ("emotion", "emotion_value", 0.65, True),
]
FALLBACK_MOTION = 0.45

GENRE_KEYWORDS = [  # first match wins
    ("comedy", ["喜剧", "comedy"]),
    ("action", ["动作", "战争", "犯罪", "武侠", "action", "war"]),
    ("suspense", ["悬疑", "惊悚", "谍战", "推理", "suspense", "thriller"]),
    ("romance", ["爱情", "恋爱", "治愈", "romance"]),
    ("drama", ["家庭", "婚恋", "复仇", "剧情", "drama"]),
]
PRESET_KEYWORDS = [  # first match wins
    ("comedy", ["喜剧", "comedy"]),
    ("action", ["动作", "战争", "犯罪", "武侠", "action", "war"]),
    ("suspense", ["悬疑", "惊悚", "谍战", "推理", "suspense", "thriller"]),
    ("romance", ["爱情", "恋爱", "治愈", "文艺", "romance"]),
    ("drama", ["家庭", "婚恋", "复仇", "剧情", "drama"]),
]
FORMAT_DEFAULTS = {
    "first_highlight_deadline_sec": "6", "original_ratio_range": "0.25,0.45", "original_clip_range_sec": "4,12",
    "max_original_over_15s": "2", "micro_cycle_sec": "12,25", "reset_interval_sec": "45,75", "vo_chars_per_sec": "4.2,5.2",
    "allow_cta": "false",
}
GENRE_PRESETS = {
    "action": {"original_ratio_range": "0.35,0.55", "original_clip_range_sec": "4,15", "max_original_over_15s": "4"},
    "drama": {"original_ratio_range": "0.35,0.55"},
    "romance": {
        "original_clip_range_sec": "4,18", "max_original_over_15s": "4", "micro_cycle_sec": "16,30",
        "reset_interval_sec": "50,90", "vo_chars_per_sec": "3.8,4.8",
    },
    "suspense": {"vo_chars_per_sec": "4,5"},
    "comedy": {"original_clip_range_sec": "4,15", "max_original_over_15s": "3"},
}
DURATION_RANGES = {"highlight": (30, 90), "short": (180, 360), "standard": (360, 600), "deep": (600, 1200)}

CODEC_OF_ENCODER = {
    "libx264": "h264", "libx264rgb": "h264", "libopenh264": "h264", "libx265": "hevc", "libvpx": "vp8",
    "libvpx-vp9": "vp9", "libaom-av1": "av1", "libsvtav1": "av1", "libfdk_aac": "aac", "libmp3lame": "mp3",
    "libopus": "opus", "libvorbis": "vorbis",
}
CODEC_PREFIXES = ["h264", "hevc", "av1", "vp9"]

CLAIM_MODALITIES = {
    "identity": ["video"], "action": ["video"], "sequence": ["video"], "causality": ["video"], "motivation": ["video"],
    "reveal": ["video"], "dialogue_text": ["audio"], "tone": ["audio"], "speaker": ["video", "audio"],
    "sound_event": ["audio"], "silence": ["audio"],
}
SIDECAR_FORMATS = [".srt", ".ass", ".vtt", ".ssa"]
SIDECAR_LANGUAGE = (
    r"(?i)^(?:zh(?:[-_.](?:cn|tw|hk|hans|hant))?|en(?:[-_.](?:us|gb))?|chs|cht|cn|eng|ja|jp|jpn|ko|kor|fr|de|es|ru|pt|it|"
    r"简体|繁体|中文|简体中文|繁体中文|中英|双语)(?:[-_. ](?:forced|sdh|cc|default))*$"
)
EVALUATION_TARGETS = {"scope_coverage": 90, "routing_mode": 90, "execution": 90, "production_usability": 85}
