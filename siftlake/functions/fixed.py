"""Word lists, maps and limits that results depend on."""

# Tiers by detection type; any other type is T4.
TIER_OF_TYPE = {
    "핵_치트": "T1",
    "불법프로그램_배포": "T1",
    "매크로_판매": "T1",
    "사설서버": "T2",
    "계정_거래": "T2",
    "리세마라": "T3",
    "현금화": "T3",
    "광고_도배": "T3",
    "기타": "T4",
}
DETECTION_TYPES = tuple(TIER_OF_TYPE)
OTHER_TYPE = "기타"
TIERS = ("T1", "T2", "T3", "T4")
TIER_THRESHOLDS = {"T1": 0.65, "T2": 0.75, "T3": 0.85, "T4": 0.90}

# Look-alike letters and the Latin letters they stand for.
HOMOGLYPHS = ("аеорсхуВНМТКАЕОРСХοαεκν", "aeopcxyBHMTKAEOPCXoaekv")

# Terms of the listing score.
HIGH_RISK_TERMS = (
    "hack", "cheat", "crack", "macro", "bot", "bypass", "injector", "loader", "undetected", "hwid", "aimbot", "esp", "wallhack", "keyauth",
    "trainer", "cheat engine", "핵", "치트", "매크로", "봇", "우회", "오토", "자동사냥", "사설서버", "프리서버", "外掛", "外挂", "輔助", "辅助", "破解", "私服",
    "自動", "自动", "腳本", "脚本", "掛機", "挂机", "巨集", "加速器", "修改器",
)
CONTACT_TERMS = (
    "telegram", "discord", "wechat", "weixin", "kakao", "openchat", "line", "qq号", "qq號", "qq群", "qq 群", "qq:", "dc群", "dc 群", "텔레그램",
    "디스코드", "디코", "카톡", "오픈채팅", "오픈톡", "문의", "판매", "구매", "팝니다", "삽니다", "거래", "현거래", "계정거래", "작업장", "대리", "대리육성", "톡방",
    "聯絡", "联系", "出售", "购买", "收購", "收购", "代練", "代练", "代打", "代肝", "代儲", "代储", "代充", "搬磚", "搬砖", "私訊", "私信", "私聊", "賴",
)
DOWNLOAD_TERMS = (
    "download", "release", "github", "mediafire", "mega.nz", "drive.google", "dropbox", "apk", "exe", "dll", "zip", "rar", "7z", "다운로드", "다운",
    "파일", "첨부", "下載", "下载", "附件",
)
GAME_TERMS = (
    "lineage", "리니지", "天堂", "maple", "메이플", "楓之谷", "枫之谷", "roblox", "로블록스", "valorant", "발로란트", "cs2", "counter-strike", "minecraft",
    "마인크래프트", "aion", "아이온", "blade", "bns",
)
CONTEXT_TERMS = (
    "tool", "tools", "setting", "settings", "guide", "channel", "ce", "설정", "세팅", "공유", "자료", "버전", "방입", "입장", "링크문의", "工具", "插件",
    "分享", "設定", "设置", "教程", "教學", "教学", "計算機", "计算器", "科技", "穩定", "稳定", "更新", "版本", "群", "頻道", "频道", "頻道連結", "频道链接",
    "虛寶", "虚宝",
)
LOW_INTENT_TERMS = (
    "공지", "규정", "신고", "운영자", "공식", "점검", "패치노트", "檢舉", "举报", "官方", "規定", "规定", "版規", "版规", "公告", "目錄", "目录", "入門", "入门",
    "新手", "導航", "导航", "索引",
)
LEXICON = {
    "high_risk": HIGH_RISK_TERMS,
    "contact": CONTACT_TERMS,
    "download": DOWNLOAD_TERMS,
    "game": GAME_TERMS,
    "context": CONTEXT_TERMS,
    "low_intent": LOW_INTENT_TERMS,
}
SOURCE_RISK = {"52pojie": 20, "ptt_mobile_game": 8}
DEDICATED_SOURCES = (
    "inven_lineage_classic", "ptt", "bahamut_lineage", "bahamut_lineage_m", "bahamut_lineage_w", "bahamut_lineage_classic", "bahamut_aion",
    "bahamut_aion2", "bahamut_bns", "bahamut_tl",
)

# Signal families of a fetched body, as patterns.
SIGNAL_PATTERNS = {
    "high_risk": r"핵|치트|매크로|자동사냥|우회|外掛|外挂|輔助|辅助|破解|私服|\b(?:hack|cheat|macro|bot|bypass|injector|loader|undetected|hwid|aimbot|esp|wallhack)\b",
    "contact": r"텔레그램|디스코드|오픈채팅|카톡|문의|판매|구매|聯絡|联系|出售|购买|\b(?:telegram|discord|wechat|weixin|kakao|openchat)\b|qq(?:号|號|群|:|\s+群)",
    "download": r"다운로드|다운|첨부|附件|下載|下载|\b(?:download|mediafire|mega\.nz|drive\.google|dropbox|github\.com|githubusercontent|release)\b|\.(?:exe|dll|apk|zip|rar|7z)\b",
    "credential": r"계정|비밀번호|인증|로그인|密碼|密码|帳號|账号|登录|登入|\b(?:account|password|login|credential|token|cookie|wallet)\b",
}

# Markers of pages that are no posts, in the order they are tried.
CAPTCHA_MARKERS = ("Cloudflare Ray ID", "Just a moment", "Please complete the security check", "请完成以下验证", "請完成下方驗證", "hCaptcha", "reCAPTCHA")
AUTH_WALL_MARKERS = (
    "請按下方確認鍵", "我同意，我已年滿十八歲", "請先登入", "請先登錄", "请先登录", "请登录后再访问", "您没有权限", "需要登录后才能", "Access Denied", "403 Forbidden",
    "您的请求被拦截",
)
ERROR_MARKERS = ("404 Not Found", "Page Not Found", "找不到頁面", "页面不存在", "500 Internal Server Error", "Bad Gateway")
# Rules by family of sites. A rule is (family, step, kind if it holds, where, how, markers), tried by step.
SITE_RULES = (
    ("inven", 1, "real", "all", "any", ("EXP", "인벤쪽지", "획득스킬", "추천")),
    ("ptt", 1, "unknown", "all", "not_each", ("作者", "看板", "標題", "時間")),
    ("ptt", 2, "sticky", "all", "any", ("[公告]", "[協尋]")),
    ("ptt", 3, "real", "all", "always", ()),
    ("bahamut", 1, "sticky", "1200", "any", ("巴哈姆特 30 週年", "巴哈姆特30週年", "30 週年站聚", "官方公告", "巴哈姆特官方", "活動辦法", "活動公告", "報名期間", "活動期間", "管理員公告", "板務公告")),
    ("bahamut", 2, "real", "all", "always", ()),
    ("pojie", 1, "sticky", "800", "any", ("导航索引", "导航贴", "导航帖", "新手入门", "入门导航", "入门索引", "公告", "置顶", "版规", "版主", "汇总贴", "汇总帖")),
    ("pojie", 2, "real", "all", "any", ("发表于", "楼主", "复制代码", "评分", "回帖奖励")),
    ("nga", 1, "auth_wall", "all", "any", ("请先注册或登录", "您所在的用户组")),
    ("nga", 2, "real", "all", "any", ("发表于", "楼主", "Lv.", "[s:")),
    ("tieba", 1, "error", "200", "each_short_500", ("百度首页", "贴吧")),
    ("tieba", 2, "real", "all", "any", ("回复", "楼主", "来自", "签到")),
)
SITE_FAMILIES = {"inven_lineage_classic": "inven", "52pojie": "pojie", "nga": "nga", "tieba": "tieba"}
SITE_PREFIXES = (("ptt_", "ptt"), ("ptt", "ptt"), ("bahamut_", "bahamut"), ("bahamut", "bahamut"), ("inven_", "inven"))

# Hosts, hints and file endings of the link ladder.
OFFICIAL_SUFFIXES = (
    "plaync.com", "nc.com", "ncsoft.com", "ncupdate.com", "nexon.com", "nexon.co.kr", "netmarble.com", "kakaogames.com", "wemade.com", "pearlabyss.com",
    "gravity.co.kr", "steampowered.com", "epicgames.com", "play.google.com", "apps.apple.com", "playstation.com", "xbox.com", "nintendo.com",
)
INSTALL_HINTS = (
    "download", "downloads", "install", "installer", "launcher", "client", "store", "steam", "epic games", "google play", "app store", "purple", "official",
    "다운로드", "설치", "런처", "클라이언트", "스토어", "下載", "下载", "安裝", "安装", "啟動器", "启动器", "官方",
)
WRAPPER_HOSTS = ("ref.gamer.com.tw",)
MESSENGER_SUFFIXES = ("discord.gg", "discord.com", "t.me", "telegram.me", "open.kakao.com", "line.me", "qq.com")
DOWNLOAD_ENDINGS = (".apk", ".bat", ".bin", ".cmd", ".dmg", ".exe", ".dll", ".ipa", ".jar", ".msi", ".rar", ".scr", ".tar", ".tar.gz", ".zip", ".7z")
STATIC_ENDINGS = (".avif", ".css", ".gif", ".ico", ".jpeg", ".jpg", ".js", ".png", ".svg", ".webp")
STATIC_HOSTS = ("img.shields.io", "badge.fury.io", "raw.githubusercontent.com", "github.com/user-attachments/assets")
DISTRIBUTION_HOSTS = (
    "discord.gg", "discord.com/invite", "drive.google.com", "dropbox.com", "gofile.io", "mega.nz", "mediafire.com", "t.me", "telegram.me",
    "github.com/user-attachments/files",
)
DISTRIBUTION_PATHS = ("/download", "/downloads", "/release", "/releases", "/releases/download", "/invite", "/file", "/files")
DISTRIBUTION_TEXTS = ("download", "release", "cheat", "hack", "다운", "다운로드", "배포", "판매", "구매", "무료", "가입", "텔레그램", "디스코드", "下载", "外掛")
DISTRIBUTION_KEYWORDS = (
    "download", "다운로드", "下载", "下載", "crack", "크랙", "破解", "外掛", "外挂", "辅助", "輔助", "hack", "cheat", "핵", "치트", "macro", "매크로", "bot", "봇",
)
TRADE_KEYWORDS = (
    "가격", "판매", "구매", "문의", "代儲", "代充", "面交", "蝦皮", "충전", "현금", "price", "paypal", "kakao", "line id", "微信", "wechat", "discord",
)
TRADE_PATTERNS = (r"\b\d{1,3}(?:,\d{3})+\s*원\b", r"\b\d+\s*(?:원|만원|천원)\b")

# Kinds, states and marks of fetched links, and the types of content that are read.
FETCH_KINDS = {"messenger": "messenger", "blocked": "blocked", "error": "error", "file": "file_direct_link", "web": "web"}
FETCH_STATUS = {
    "messenger": "skipped:messenger", "blocked": "blocked:", "astray": "blocked:redirect_target", "far": "error:too_many_redirects", "type": "abort:content_type:",
    "failed": "error:http_", "ok": "ok",
}
READABLE_TYPES = ("text/html", "text/plain", "application/xhtml+xml")
MESSENGER_INDICATOR, FILE_INDICATOR = "비공개 채널 유도(메신저 초대링크)", "배포 파일 직링크(%s 응답)"

# Address blocks that must not be fetched.
BLOCKED_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)

# IPv6 networks that are private, local, reserved, multicast or unspecified, and the parts of them that are global.
BLOCKED_SIX = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3",
    "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "fec0::/10", "ff00::/8",
)
GLOBAL_SIX = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

# Types of the older label set and their newer names.
OLD_TYPES = {"핵_배포": "불법프로그램_배포", "매크로_판매": "매크로_판매", "리세마라": "리세마라", "계정_거래": "계정_거래", "기타": "기타", "": "기타"}

# Post ids in addresses by site.
POST_ID_EPOCH = r"/M\.(\d+)(?:\.[A-Z]\.[0-9A-F]+)?\.html$"
POST_ID_THREAD = r"/thread-(\d+)-(\d+)-(\d+)\.html$"
POST_ID_BOARD, POST_ID_TOPIC = r"[?&]bsn=(\d+)", r"[?&]snA=(\d+)"
POST_ID_NUMBER = r"tid=(\d+)"
POST_ID_PAIR = r"^bsn(\d+)_snA(\d+)$"
THREAD_URL, BOARD_URL = "https://www.52pojie.cn/thread-", "https://forum.gamer.com.tw/C.php?bsn="

# Addresses of posts by site, rebuilt from the post id ("" marks the id).
POST_URLS = {
    "inven_maple": "https://www.inven.co.kr/board/maple/2298/",
    "inven_lineage_classic": "https://www.inven.co.kr/board/lineageclassic/6482/",
    "dcard": "https://www.dcard.tw/f/game/p/",
    "dcard_online": "https://www.dcard.tw/f/online/p/",
    "tieba": "https://tieba.baidu.com/p/",
    "nga": "https://bbs.nga.cn/read.php?tid=",
}
# Event message fields.
EVENT_REQUIRED = ("post_id", "source_id", "site_name", "raw_text", "language", "detected_at", "correlation_id")
EVENT_OPTIONAL = ("image_urls", "s3_text_path", "s3_image_paths", "post_url")
LANGUAGE_CODES = {"zh-cn": "zh-CN", "zh-tw": "zh-TW"}
DEFAULT_LANGUAGE = "ko"
