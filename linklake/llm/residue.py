"""Texts that are nothing but template residue: unfilled placeholders, filler, error pages, notices that scripts are needed.

A text is judged sentence by sentence. Placeholders are found by one grammar for each kind of delimiter and count only
where they are dense, so that a sentence that explains a placeholder stays content; fenced code is content too, and code
in backticks counts against the density of its sentence. Filler is found by its word stock, by keyboard runs and by
repetition. Error pages, notices and stand-in texts are found by the roles of their words: nearly all words of such a
sentence name things that fail, failures, negated acts, scripts or advice, and one of them says what is wrong; a longer
sentence must also speak to the reader or point at the page, or it tells about such pages. Titles, menus and footers (short
lines without the shape of a sentence) count neither way. A text is residue if it has residue and no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = r"[^\W\d][\w.\-]*"
#: One grammar for each delimiter.
GRAMMARS = [
    r"\{\{(?:[^{}\n]|\{[^{}\n]*\})+\}\}",
    r"\{%(?:[^%\n]|%(?!\}))+%\}",
    r"<%(?:[^%\n]|%(?!>))+%>",
    r"\$\{[^{}\n]+\}",
    r"#\{[^{}\n]+\}",
    rf"\{{\s*{_NAME}\s*\}}",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    rf"\[\s*{_NAME}(?:[ ]{_NAME}){{0,3}}\s*\]",
    rf"<\s*/?{_NAME}\s*/?>",
    rf"%{_NAME}%",
    rf"\${_NAME}\$",
    r"%\([^()\n]{1,40}\)[sd]",
    rf"__{_NAME}?__|__[^\W\d]\w*__",
    rf"@@{_NAME}@@",
    rf"«\s*{_NAME}\s*»",
    rf"(?<![A-Za-z0-9]):{_NAME}:(?![A-Za-z0-9/])",
    r"\[object Object\]",
]
_PLACEHOLDER = re.compile("|".join(GRAMMARS), re.I)
#: Values that a template shows for missing data.
_NOTHING = re.compile(r"\[object Object\]|\b(?:None|null|undefined|NaN)\b", re.I)
#: Least share of placeholders among the units of a sentence.
DENSITY = 0.2

# Stems of the usual filler text.
LOREM = """lorem ipsum dolor sit amet consectetur consequat adipiscing elit sed do eiusmod tempor incididunt ut labor labore et
dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo duis aute
irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
proident sunt culpa qui officia deserunt mollit anim id est laborum"""
_LOREM = re.compile(r"(?:" + "|".join(sorted(set(LOREM.split()), key=len, reverse=True)) + r")(?:us|um)?", re.I)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

# The words that failure pages, notices and stand-in texts are made of, by role and not by sentence.
#: What fails or is asked for.
THINGS = """line port layout design menu section account address app application article back browser browsers certificate channel connection content cookies copy
data database document domain element entry file form gateway home homepage host http https image item javascript js link
listing login menu message network object page pages path permission post product profile protocol proxy reason record
request resource robot robots script scripting scripts security server service session shop site start store support
system template text token traffic url user video visitor web webpage website widget window"""
#: States that are failures by themselves.
FAILURES = """archived bad banned blocked broken closed conflict deactivated deleted denied disabled down error errors
exceeded exception expired fail failed fails failure forbidden gone inaccessible interrupted invalid limit locked lost
maintenance missing moved offline oops overloaded parked problem problems refused rejected removed reset restricted snag
sorry suspended terminated timeout traceback trouble unable unauthorised unauthorized unavailable unexpected
unfortunately unknown unreachable withdrawn wrong"""
#: States and acts that are failures when they are negated.
ACTS = """private trusted safe accept accepted acceptable access accessed accessible allowed answer available complete completed connect connected
display displayed drawn establish established exist existed exists fetch find found fulfil fulfill handle handled
implemented lives load loaded locate located open opened process processed reach reachable reached read render rendered
respond responding responds retrieve serve served show shown start supported valid work works"""
NEGATIONS = """not no never nothing cannot without couldn can't couldn't isn't wasn't doesn't didn't hasn't won't don't
unable failed longer neither nor none"""
#: What such pages tell the reader to do.
ADVICE = """activate again agree allow ask automatically check checked checking come complete contact continue enable
enabled go hold ensure keep later loading make minutes moment needed needs need off on only please protected press properly
proceed ray refresh reload requirement requires require required retry return returned second seconds secure sign skip
slow switch switched takes took try trying turn turned update use using verification verify verifying visit wait
while human humans person bot captcha click here tab few many much long too"""
#: Words that stand in for a text to come.
STANDINS = """layout design element block show how looks look short folder list column row field demo add block caption coming company copy description dummy email enter example filler fill follow following goes
comes headline heading here image insert intro later line live logo lorem name paragraph phone placeholder replace sample
section slogan sub subtitle summary tagline tbd text this title to todo type your before going nothing"""
#: Stand-ins that are enough by themselves.
MARKS = "replace insert dummy filler lorem placeholder sample tbd todo blindtext platzhalter platzhaltertext beispieltext factice provisoire einfügen hier here"
LITTLE = """end hit soon establishing loading reading settings setting before occurred happened encountered stays stay remains remain empty blank hidden a about administrator after all already also an and any anymore are as asked at be because been being but by can code could
currently did do does for from had has have his how i if in internal into is it its just know let list look looked
looking made may might more most must my now of off old on once one or other our out over own owner permanently persist
persists possibly re requested s seem seems she so some something still t temporarily than that the their them then
there these they this those time to today tried up us very via was we were what when where whether which who will with
would you your yours set sure under due everywhere feel free getting id instead might new number reference ref status
see team technical than them want went"""
GERMAN = """lässt sich lassen layout text hier aktivieren aktiviert aktuell angeforderte anzeigen anzeige auf aufgetreten aufrufen aus bald befindet bei besuchen bitte
browser cookies das dass den der des deutsch die dienst dies diese dieser dieses dokument ein eine einem einen einer erforderlich
erlauben erneut erreichbar erreicht es existiert fehler fehlgeschlagen für gefunden gelöscht geladen gesperrt hat
haben ich ihr ihre ihrem ihren im in ist javascript kann keine kein konnte können laden leider mehr mit nicht noch nur nutzen
oder ohne prüfen prüfung seite seiten server sie sind skript skripte später startseite überprüft überprüfen um und unerwarteter
verbindung verfügbar verschoben verweigert versuchen versucht von vorübergehend warten wartung website wenn werden wieder wird wurde
zeit zu zugriff zum zur zurück zurzeit zwischen adresse inhalt dauert sekunden mensch einschalten gibt"""
FRENCH = """a accès accueil activer afficher après au aucun autorisé avec avez ce cette chargée chargement charger code cookies contenu dans de demandée demandé des
désolé désolés disponible du elle en erreur est et être exige existe expiré fichier fonctionne il impossible indisponible
inattendue introuvable interdit javascript je la le les lien ligne mais maintenance merci moment n navigateur ne nécessite
nous ou page par pas patienter permission plus pour quelques refusé réessayer retour s sans script scripts
serveur service session site son supprimée supprimé survenue sur tard temporairement trouvée trouvé un une vérification vérifier
veuillez votre vous y êtes été secondes d l"""
#: Failures and script words of the other languages.
OTHER_FAILURES = """fehler fehlgeschlagen gelöscht gesperrt verweigert leider wartung unerwarteter verschoben erreur introuvable refusé
indisponible impossible interdit expiré supprimée supprimé survenue désolé désolés"""
OTHER_NEGATIONS = "nicht keine kein ohne pas sans aucun ne n"
SCRIPT = "javascript js script scripts scripting skript skripte cookies noscript"
CHECKS = "browser browsers human humans robot robots bot captcha navigateur verification verifying vérification überprüft mensch loading chargement"
DO = """activate allow enable enabled off on needs need requires require required turn turned switch switched permit disabled blocked missing without no not support supported only
aktivieren erlauben einschalten ohne nicht activer exige nécessite sans pas"""
#: Words of Chinese pages, without blanks between them.
CHINESE_FAILURES = "不存在 找不到 无法 没有权限 没有访问 出错 错误 失败 繁忙 不可用 已被删除 已删除 已过期 已关闭 抱歉 未找到 拒绝 禁止 维护 超时 异常 失效 下线 停用"
CHINESE_SCRIPT = "启用脚本 开启脚本 启用javascript 开启javascript 打开javascript 需要javascript 需要开启 需要启用 未开启 未启用 禁用了 不支持 人机验证 安全验证 检查浏览器 加载中 请开启"
CHINESE_STANDINS = "占位 示例文字 示例文本 示例内容 待填写 待补充 此处填写 在此输入 稍后替换 请输入 测试文字 测试文本"
CHINESE = """这是 一段 这 一个 用于 排版 布局 简短 页面 网页 网站 站点 服务器 服务 请求 访问 权限 没有 您 你 的 了 此 该 这个 本 已 被 或 已经 请 稍后 再试 重试 刷新 返回 首页 上一页
联系 管理员 暂时 目前 内部 发生 脚本 浏览器 检查 验证 正在 加载 开启 启用 打开 后 才能 继续 浏览 使用 内容 文字 文本 段落 标题 填写 替换 输入 此处 这里 在 是 请求的 链接 地址 资源 文件
需要 功能 正常 显示 查看 我们 系统 网络 连接 账号 用户 登录 会话 重新 可能 移动 更改 一下 片刻 等待 稍等 几秒 人 不 能 到 中 和 与 用 将 时 后重试 javascript cookie cookies js"""


def _words(*texts: str) -> frozenset[str]:
    return frozenset(w for t in texts for w in t.split())


_FAILURES, _ACTS, _NEGATIONS = _words(FAILURES, OTHER_FAILURES), _words(ACTS), _words(NEGATIONS, OTHER_NEGATIONS)
_SCRIPT, _CHECKS, _DO, _MARKS = _words(SCRIPT), _words(CHECKS), _words(DO), _words(MARKS)
_PAGE = _words(THINGS, FAILURES, ACTS, NEGATIONS, ADVICE, LITTLE, GERMAN, FRENCH, OTHER_FAILURES, OTHER_NEGATIONS, SCRIPT, CHECKS, DO)
_ADVICE = _words(ADVICE)
_STANDIN = _words(STANDINS, MARKS, LITTLE, GERMAN, FRENCH) | {"texte", "text", "lien", "linktext", "titel"}
_POINTING = _words("this these your you we our us please sorry requested here try enable turn allow activate diese dieser dieses ihr ihre ihrem sie bitte wir ce cette votre vous veuillez nous unable access hold checking checks verifying")
_FOREIGN, _WAITING = _words(GERMAN, FRENCH), _words("again retry reload refresh wait hold skip later moment")
_EXCESS, _TEXT = _words("many long large"), _words("text copy content image description caption")
_HAN = re.compile("[㐀-䶿一-鿿]")
_alternatives = lambda *t: re.compile("|".join(sorted(_words(*t), key=lambda w: (-len(w), w))))
_CHINESE_TRIGGER = _alternatives(CHINESE_FAILURES, CHINESE_SCRIPT, CHINESE_STANDINS)
_CHINESE_ANY = _alternatives(CHINESE_FAILURES, CHINESE_SCRIPT, CHINESE_STANDINS, CHINESE)
#: Status codes, error codes, hosts, paths and identifiers, which carry no words.
_CODES = re.compile(r"(?<!\w)['\"][^'\"\n]{1,40}['\"](?!\w)|(?:https?://|/)\S*|\b[\w\-]+(?:\.[\w\-]+)+\b(?:/\S*)?|\b(?:err|dns|net|http|ssl|ora)_[a-z0-9_]+\b|\b(?=\w*\d)\w+\b|\b\w+(?:error|exception)\b", re.I)
_STATUS = re.compile(r"\b[45]\d\d\b|\b(?:err|dns|net|ssl)_\w+|\b\w+(?:error|exception)\b", re.I)
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Least share of a sentence's words that must come from the lists, and most words of such a sentence.
#: Notices about scripts may name what doesn't work, so they need less.
COVER, COVER_OTHERS, LONGEST = 0.78, 0.88, 40
#: A sentence of more than so many words must speak to the reader or point at the page, or it tells about such pages.
TELLING = 9


def _failure(sentence: str) -> bool:
    """Whether a sentence is made of the words of failure pages, notices or stand-in texts and says one of them: a
    failure, a negated act, a status code, scripts with what to do about them, or a stand-in."""
    low = sentence.lower().replace("’", "'")
    if _HAN.search(low):
        low = re.sub(r"\s+", "", low)
        if not _CHINESE_TRIGGER.search(low):
            return False
        n = len(_HAN.findall(low))
        return len(_HAN.findall(_CHINESE_ANY.sub("", low))) <= (1 - COVER) * n
    bare = _CODES.sub(" ", low)
    words = [w if w in _NEGATIONS else w.split("'")[0] for w in _PLAIN.findall(bare)]
    status = bool(_STATUS.search(low))
    if len(words) > LONGEST:
        return False
    if not words:
        return status
    known = set(words)
    if len(words) > TELLING and not known & _POINTING:
        return False
    share = sum(w in _PAGE or w[-1] == "s" and w[:-1] in _PAGE for w in words) / len(words)
    if share >= COVER and known & _SCRIPT and (known & _DO or len(words) <= 3):
        return True
    if share >= COVER_OTHERS:
        german_or_french = len(known & _FOREIGN) >= 3
        if status or known & _FAILURES or known & _NEGATIONS and (known & _ACTS or german_or_french) or "too" in known and known & _EXCESS:
            return True
        if known & _CHECKS or known & _WAITING and (len(known & _ADVICE) >= 2 and len(words) <= 16 or len(words) <= 4):
            return True
    stand_in = known & _MARKS or "follow" in known and known & _TEXT
    return bool(stand_in) and sum(w in _STANDIN for w in words) >= COVER * len(words) and len(words) <= 12


_CODE = re.compile(r"`+([^`]+)`+")
_MENU = re.compile(r"[·|/>»•]")
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_UNIT = re.compile(r"[㐀-䶿一-鿿]{1,2}|[^\W\d㐀-䶿一-鿿][^\W㐀-䶿一-鿿]*(?:['’\-][^\W㐀-䶿一-鿿]+)*")
_STOP = re.compile(r"[.!?。！？;；]\W*$")


def _filler(words: list[str]) -> bool:
    n = len(words)
    if not n:
        return False
    low = [w.lower() for w in words]
    if all(set(w) == {"x"} for w in low):
        return True
    if n >= 3 and sum(bool(_LOREM.fullmatch(w)) for w in low) >= 0.6 * n:
        return True
    if n >= 3 and sum(len(w) >= 3 and any(w in r for r in _ROWS) for w in low) >= 0.8 * n:
        return True
    return n >= 3 and len(set(low)) == 1 or n >= 6 and len(set(low)) * 4 <= n


def judge(sentence: str) -> str:
    """``residue``, ``content`` or ``label`` (neither: no words, or a line of a title, menu or footer)."""
    code = sum(len(_UNIT.findall(c)) or 1 for c in _CODE.findall(sentence)) if "`" in sentence else 0
    plain = _CODE.sub(" ", sentence) if code else sentence
    found = _PLACEHOLDER.findall(plain)
    bare = _PLACEHOLDER.sub(" ", plain) if found else plain
    words = _UNIT.findall(bare)
    nothing = len(_NOTHING.findall(bare))
    marks = len(found) + nothing
    if marks and marks >= DENSITY * (len(words) + code - nothing + marks):
        return "residue"
    if code <= DENSITY * (len(words) + code) and _filler(words) or code <= DENSITY * (len(words) + code) and _failure(plain):
        return "residue"
    return "content" if words or code else "label"


def _label(line: str) -> bool:
    """A title, menu or footer: a heading, or a short line without the end of a sentence and without an address."""
    if line.startswith("#"):
        return True
    words = _UNIT.findall(line)
    if _CODE.search(line):
        return False
    return "://" not in line and not _STOP.search(line) and len(words) <= 16


def is_residue(text: str | None, labels: int = 6) -> bool:
    """Whether ``text`` has residue and, but for up to ``labels`` lines of titles, menus and footers, nothing else."""
    if not text or not text.strip():
        return False
    hits, lines_apart, fenced = 0, 0, False
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            return False
        if line.startswith("#"):
            lines_apart += 1
            continue
        kinds = [judge(line)]
        if kinds[0] == "content":
            parts = [p for chunk in re.split(r"\s{2,}", line) for p in _END.split(chunk) if p.strip()]
            kinds = [judge(p) for p in parts] if len(parts) > 1 else kinds
            for k, part in zip(kinds, parts):
                if k == "content" and not _label(part):
                    return False
        hits += kinds.count("residue")
        lines_apart += kinds.count("content")
        if lines_apart > labels + hits:
            return False
    return hits > 0


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that are nothing but residue.

    Null, blank and short plain texts are no cases. Each text is judged whole and on its own, so a text of any length
    costs its own length and no shuffle is needed. Repeated rows come out as often as they came in; an empty table gives
    no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array([is_residue(t) for t in b.column(1).to_pylist()], pa.bool_()))

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint")


def without_residue(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are no residue, all columns as they are; rows with a null id are kept."""
    return documents.join(find_residue(documents).distinct(), "doc_id", "left_anti")
