"""Word lists, patterns and constants that results depend on, kept together and in natural order."""

# Store brands, in order of priority.
BRANDS = [
    "セブン-イレブン", "ファミリーマート", "FamilyMart", "LAWSON", "ローソン", "ミニストップ", "デイリーヤマザキ", "NewDays", "セイコーマート",
    "MOS BURGER", "モスバーガー", "うさちゃんクリーニング", "Ringer Hut", "リンガーハット", "LUPICIA", "ルピシア", "apollostation", "アポロステーション",
]

# Misread glyphs, repaired in this order, and simplified glyphs with their Japanese forms.
REPAIRS = [("言十", "計"), ("百十", "計"), ("合十", "合計")]
SIMPLIFIED, JAPANESE = "额领对费减轻", "額領対費減軽"
SEMI_VOICED, VOICED = "パピプペポ", "バビブベボ"

# Patterns.  (?U): Unicode classes, (?d): only \n ends a line.
COMPACT = r"(?Ud)[\s\-‐‑–—―ー・.]"
GAP = r"[^\S\n]*"
GAP_OR_LINE = r"[^\S\n]*\n?[^\S\n]*"
MONEY = r"[¥\\]?[^\S\n]*(\d{1,3}(?:[,，.][^\S\n]*\d{3})+|\d+)"
LABELS = {
    "total": r"(?<!り)合\s*計[^\S\n]*[>)\]]?[^\S\n]*(?:金\s*額)?",
    "deposit": r"(?:お\s*預\s*か?\s*り?[^\S\n]*(?:合\s*計)?|現\s*金)",
    "change": r"お\s*[釣鈎釘勺つ]\s*り?",
}
TAX = (
    r"(?:(\d{1,2}(?:\.\d+)?)\s*%\s*対象\s*)?(?:内?\s*消\s*費\s*税\s*[等額]?|内\s*税\s*額?)[^\S\n]*\)?[^\S\n]*"
    r"(?:\(?\s*(\d{1,2}(?:\.\d+)?)\s*%\s*\)?)?[^\S\n]*" + MONEY + r"(?!\d)(?![^\S\n]*%)"
)
DATES = [
    r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日",
    r"(?<!\d)(\d{4})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{1,2})(?=\D|$|\d{1,2}\s*[:：])",
    r"(?<![\d.])(\d{2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})(?=\D|$|\d{1,2}\s*[:：])",
]
TIMES = [r"(\d{1,2})\s*[:：]\s*(\d{2})(?!\d)", r"(\d{1,2})\s*時\s*(\d{1,2})\s*分"]
REGISTRATION = r"T\d{13}"
CAPITALS = r"[A-Z]{4,}"
TOWN_FIRST = r"^[一-龥]{2,3}[都道府県][一-龥]{1,4}[市郡区](?=.+店)"
BRANCH = r"([ぁ-んァ-ヶ一-龥A-Za-z][ぁ-んァ-ヶ一-龥A-Za-z0-9ー\-]*店)(?=$|[一-龥]{2,3}[都道府県])"
LEGACY = {
    "store_branch": r"\S+店",
    "time": r"(\d{1,2}):(\d{2})",
    "total": r"合\s計\s[¥￥]?\s*([\d,]+)",
    "deposit": r"お預[りか]\s*(?:合計)?\s*[¥￥]?\s*([\d,]+)",
    "change": r"お\s釣\s[り]?\s*[¥￥]?\s*([\d,]+)",
    "tax": r"消費税額?\s*[¥￥]?\s*([\d,]+)",
}
LINE_BRANCH = [r"[ぁ-んァ-ヶ一-龥A-Za-z][ぁ-んァ-ヶ一-龥A-Za-z0-9ー\-]*店$", r"[ぁ-んァ-ヶ一-龥A-Za-z][ぁ-んァ-ヶ一-龥A-Za-z0-9ー\-]*?店"]
LINE_AMOUNT = r"(?:([¥\\])\s*)?(\d{1,3}(?:[,，.]\s*\d{3})+|\d+)"
LINE_RATE = r"(\d{1,2}(?:\.\d+)?)\s*%"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
GUARDS = {"deposit": r"預|現\s*金", "change": r"[釣鈎釘]|つり"}

# Thresholds.
FUZZY, OVERLAP, LABEL_THRESHOLD = 0.8, 0.5, 0.80
SHORT_EDGE, SHORT_EDGE_WARN, DARK, BRIGHT, SHARP, TILT, TEXT_AREA = 400, 640, 60, 220, 50, 15, 0.01

# Fields in their order.
FIELDS = ["store_brand", "store_branch", "registration_number", "date", "time", "total", "tax", "deposit", "change"]
FALLBACK_FIELDS = ["total", "deposit", "change", "tax", "date", "time", "store_branch", "registration_number"]

# Degradation strengths, and prefixes of embeddings and thresholds that sweeps go through.
STRENGTHS = ["light", "medium", "heavy"]
SWEEP = [0.70, 0.75, 0.80, 0.85, 0.90]

#: Made-up shops of generated receipts, by template.
SHOPS = {
    "conv": ["ミナトコンビニ", "ほしぞらマート", "カワセミストア", "あさつゆショップ"],
    "super": ["たんぽぽ青果市場", "ヤマネコフーズ", "いろどり生鮮館", "オリオン食品センター"],
    "dining": ["そば処ひぐらし", "カレー工房ラクダ", "ピザハウスつばめ", "とんかつ亭まつかぜ"],
    "service": ["さざなみ洗濯舎", "靴修理こまどり", "フォトスタジオ月見草"],
}
BRANCHES = ["北港店", "柳橋店", "三本松店", "西野駅前店", "桜坂本店", "大川端店", "湖畔公園店", "東雲町店"]
WEEKDAYS = "月火水木金土日"

# Sizes of printed receipts.
BASE_SIZE, MARGIN, DASH_HEIGHT, LINE_HEIGHT = 22, 36, 1.2, 1.45

# Sentences that stand for each kind of line, in order, and lines of no kind.
PROTOTYPES = {
    "total": ["合計 ¥494", "合 計 ¥1,800", "合計金額 ¥2,503", "お買上げ計 ¥1,234", "お買上合計 ¥3,150", "総合計 ¥5,000", "ご請求金額 ¥1,000", "合計(税込) ¥980", "¥2,503.-", "10%対象合計金額 ¥1,280"],
    "deposit": ["お預り ¥1,000", "お預かり ¥10,000", "お預り合計 ¥10,000", "現金 ¥6,000", "現金お預り ¥5,000", "お預り金額 ¥2,000"],
    "change": ["お釣り ¥506", "おつり ¥0", "お釣 ¥9,506", "お釣り銭 ¥494"],
    "tax": ["(内消費税等 ¥36)", "内消費税額 ¥36", "消費税等(8%) ¥21", "内税額 10.0% ¥228", "(内税) ¥388", "10%対象内消費税 ¥290", "(内税分消費税 ¥91)", "消費税 ¥100"],
    "datetime": ["2026年 6月16日(火) 18:53", "2026年04月16日(木) 10:29", "2026/07/10 20:59", "2026.6.9 16:07", "2026年7月10日 18時36分", "26.07.07 09:19", "2026年01月05日 12:34 伝票No.1234", "26.03.15 10:20 レジ2 責105", "領収日付:2026年4月18日 13時05分"],
    "store_branch": ["新宿東口店", "渋谷駅前店", "本町一丁目店", "イオンモール北店", "セルフ青葉台店"],
    "registration_number": ["登録番号 T1234567890123", "事業者登録番号 T9876543210987", "登録番号:T2345678901234"],
}
DISTRACTORS = [
    "電話：018-853-0502", "TEL 0120-134-890", "電話番号 0120-000-000", "東京都新宿区西新宿1-2-3 ビル2F", "大阪府大阪市北区梅田1-2-3", "小計 ¥268", "小計(税抜8%) ¥268", "(税率8%対象 ¥289)", "(8%対象 ¥494)",
    "10%対象 ¥3,150", "10%対象額 ¥3,650", "8%対象額 ¥750", "(商品代金 ¥288)", "値引額 -20", "(値引合計 -20)", "ハウスWウコンのカ100ml", "コーヒー ¥130", "牛乳 1点 ¥208", "入浴料 大人1名 ¥950", "施設利用料 ¥1,200",
    "会員入会金 ¥1,500", "PayPay支払 ¥289", "クレジット支払 ¥5,240", "ポイント残高 120P", "点数 2個", "上記正に領収いたしました", "ありがとうございました。またお越しくださいませ", "軽印は軽減税率対象商品です。", "#1227620260416102935416120216895",
    "伝票番号 260-416-243-1757", "レジ#2 担当:佐々木", "領収書", "株式会社ローソン",
]
