"""Model constants.

FIXED VALUES: the numbers and labels below must equal the scoring rules being reproduced,
otherwise results differ. They are stated plainly and kept together on purpose.
"""

# --- fixed values: bin label -> rank ---------------------------------------------------------
BIN2RANK = {
    "10%이하": 0.05, "10-25%": 0.175, "25-50%": 0.375,
    "50-75%": 0.625, "75-90%": 0.875, "90%초과": 0.95,
    "10% 이하": 0.05, "10 ~ 25%": 0.175, "25 ~ 50%": 0.375,
    "50 ~ 75%": 0.625, "75 ~ 90%": 0.875, "90% 초과": 0.95,
}

# --- fixed values: component weights ---------------------------------------------------------
ALPHA = 0.4   # sales
BETA = 0.3    # customer
GAMMA = 0.3   # market

# --- fixed values: model ensemble weights (tag -> weight), blend lambda -------------------------
ENSEMBLE_WEIGHTS = {"xgb": 0.25, "lgbm": 0.25, "rf": 0.25, "gb": 0.15, "dl": 0.10}
ENSEMBLE_ALIASES = {"xgb": ["pred_xgb"], "lgbm": ["pred_lgbm"], "rf": ["pred_rf"],
                    "gb": ["pred_gb", "pred_gbdt"], "dl": ["pred_dl", "pred_nn"]}
LAMBDA_BLEND = 0.6

# --- fixed values: absolute alert thresholds with persistence ------------------------------------
THRESHOLDS = {"yellow": 0.20, "orange": 0.30, "red": 0.40, "delta": 0.05, "persistence_k": 3}

# --- fixed values: numeric conventions -------------------------------------------------------
VERY_NEGATIVE_SV = -9e5
EPS = 1e-6
ROLL_WINDOW = 12
MIN_PERIODS = 6
MAD_SCALE = 1.4826
LOGIT_CLIP = 1e-6

# --- fixed values: quantile alert cut-offs (within group) ---------------------------------------
QUANTILE_CUTS = (0.80, 0.90, 0.97)   # YELLOW, ORANGE, RED
# --- fixed values: service alert cut-offs ------------------------------------------------------
SERVICE_CUTS = (0.7, 0.9)            # ORANGE, RED

# --- fixed values: market base by industry (quick score) -----------------------------------------
BASE_MARKET = {"default": 0.55, "치킨": 0.56, "카페": 0.54, "피자": 0.57, "편의점": 0.53}

# --- fixed values: six rank bins in the raw data, in order ---------------------------------------
BIN_COLS = ["RC_M1_SAA", "RC_M1_TO_UE_CT", "RC_M1_UE_CUS_CN", "RC_M1_AV_NP_AT", "APV_CE_RAT", "MCT_OPE_MS_CN"]

AGE_COLS = ["M12_MAL_1020_RAT", "M12_MAL_30_RAT", "M12_MAL_40_RAT", "M12_MAL_50_RAT", "M12_MAL_60_RAT",
            "M12_FME_1020_RAT", "M12_FME_30_RAT", "M12_FME_40_RAT", "M12_FME_50_RAT", "M12_FME_60_RAT"]
TYPE_COLS = ["RC_M1_SHC_RSD_UE_CLN_RAT", "RC_M1_SHC_WP_UE_CLN_RAT", "RC_M1_SHC_FLP_UE_CLN_RAT"]

# --- fixed values: model feature columns ------------------------------------------------------
NUM_FEATURES = ["M1_SME_RY_SAA_RAT", "M1_SME_RY_CNT_RAT", "M12_SME_RY_SAA_PCE_RT", "M12_SME_BZN_SAA_PCE_RT",
                "M12_SME_RY_ME_MCT_RAT", "M12_SME_BZN_ME_MCT_RAT", "DLV_SAA_RAT", "MCT_UE_CLN_REU_RAT",
                "MCT_UE_CLN_NEW_RAT"]
CAT_FEATURES = ["HPSN_MCT_ZCD_NM", "HPSN_MCT_BZN_CD_NM"]

KEY_MCT = "ENCODED_MCT"
KEY_YM = "TA_YM"
INDUSTRY = "HPSN_MCT_ZCD_NM"
AREA = "HPSN_MCT_BZN_CD_NM"
CLOSE_DATE = "MCT_ME_D"

# --- fixed values: text parsing (utterances) ----------------------------------------------------
INDUSTRY_KEYWORDS = [  # (industry, keywords) in match order
    ("치킨", ["치킨", "치킨집", "후라이드", "양념치킨"]),
    ("카페", ["카페", "커피", "디저트", "베이커리"]),
    ("피자", ["피자"]),
    ("편의점", ["편의점", "CVS"]),
]
MONEY_UNITS = {"원": 1.0, "만원": 1e4, "천만원": 1e7, "억원": 1e8}
DELIVERY_PHRASES = [(["배달 위주", "배달 중심"], 0.8), (["포장 위주", "테이크아웃 위주"], 0.6),
                    (["홀 위주", "내점 위주"], 0.3)]
REQUIRED_SLOTS = ["industry_code", "region_code", "sales_1m", "sales_3m_avg"]
FOLLOW_UP_QUESTIONS = {
    "industry_code": "어떤 업종인가요?",
    "region_code": "어느 지역인가요?",
    "sales_1m": "최근 한 달 매출은?",
    "sales_3m_avg": "최근 3개월 평균 매출은?",
}

# --- fixed values: explanation and recommendation texts ------------------------------------------
EXPLAIN_SALES = "최근 1→3개월 대비 매출 모멘텀 둔화"
EXPLAIN_CUSTOMER = "고객 수 감소 신호"
EXPLAIN_MARKET = "지역/업종 시장 위험도 상회"
EXPLAIN_DEFAULT = "위험 신호는 크지 않음"
RECOMMEND_SALES = ["💰 매출 개선: 프로모션 이벤트나 신메뉴 출시를 고려하세요",
                   "📊 가격 전략: 경쟁사 가격을 분석하고 차별화된 가격 정책을 수립하세요"]
RECOMMEND_CUSTOMER = ["👥 고객 유지: 단골 고객 대상 리워드 프로그램을 운영하세요",
                      "⭐ 리뷰 관리: 부정적 리뷰에 신속히 대응하고 개선하세요"]
RECOMMEND_MARKET = ["🎯 차별화: 경쟁업체와 차별화된 강점을 부각하세요",
                    "📱 온라인 강화: 배달앱 외 자체 채널을 개발하세요"]
RECOMMEND_RED = "⚠️ 긴급 조치: 비용 구조 재검토 및 전문가 상담을 권장합니다"
RECOMMEND_DEFAULT = "✅ 현재 위험 신호는 크지 않습니다. 지속적으로 모니터링하세요."
ALERT_EMOJI = {"GREEN": "🟢", "YELLOW": "🟡", "ORANGE": "🟠", "RED": "🔴"}
