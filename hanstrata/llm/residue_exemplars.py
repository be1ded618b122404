"""Labelled exemplars of template residue, filler, error pages and script notices.

A set to start from: residue_documents() takes any other table of labels and texts. Fixed values.
W in a placeholder stands for words, of SHORT placeholders one to four, 0 for digits.
"""

# Placeholders, in compatibility-composed form.
PLACEHOLDERS = (
    "{{ W }}", "{{{ W }}}", "${ W }", "#{ W }", "{ 0 }", "{% W %}", "<%= W %>", "<% W %>", "<? W ?>", "[[ W ]]", "%( W )s", "%( W )d",
    "%% W %%", "@@ W @@", "__ W __", "&lt; W &gt;", "$$ W $$", "## W ##", "<< W >>",
    "[ insert W ]", "[ insert W here ]", "< insert W >", "< insert W here >", "( insert W here )", "{ insert W }", "[ your W ]", "< your W >", "{ your W }", "[ enter W ]", "[ enter W here ]",
    "[ W here ]", "[ add W here ]", "[ type W here ]", "[ fill in W ]", "[ todo ]", "[ todo W ]", "[ tbd ]", "[ placeholder ]", "< placeholder >", "[ W placeholder ]",
    "[ W 입력 ]", "[ W 을 입력 ]", "[ W 를 입력하세요 ]", "[ W 입력하세요 ]", "[ W 기입할 것 ]", "[ W 기입 ]", "[ W 를 기입하시오 ]", "[ W 쓰시오 ]", "< W 여기에 쓰시오 >", "< W 쓰시오 >", "< W 입력 >", "[ 여기에 W ]", "< 여기에 W >", "[ W 작성 ]", "( W 기입할 것 )", "( 여기에 W 입력 )",
    "[ ここに W ]", "[ W を入力 ]", "[ W を記入 ]", "[ W を入力してください ]", "< W を入力 >",
    "[ 请输入 W ]", "[ 在此输入 W ]", "[ 此处填写 W ]", "[ 請輸入 W ]", "< 请输入 W >",
    "[ insertar W ]", "[ inserte W ]", "[ escriba W ]", "[ insérer W ]", "[ saisir W ]", "[ votre W ]", "[ su W ]",
)

# Placeholders that with more words are as well an editor's note, a stage direction, a quotation or text between two blanks of a form.
SHORT = (
    "[[ W ]]", "%% W %%", "@@ W @@", "__ W __", "&lt; W &gt;", "$$ W $$", "## W ##", "<< W >>", "[ your W ]", "< your W >", "{ your W }", "[ enter W ]", "[ W here ]", "[ W 기입 ]", "[ 여기에 W ]", "< 여기에 W >", "[ W 작성 ]", "[ ここに W ]", "[ votre W ]", "[ su W ]",
)

# Sentences that a layout holds until its text comes.
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sample text goes here.", "Dummy content to be replaced.", "Placeholder copy for layout only.", "Test paragraph number 1.", "Your text here.", "This is a sample paragraph.", "Insert content here.", "Text to be added later.", "Content coming soon.", "Body copy goes here.", "This page is intentionally left blank.",
    "Texto de relleno para la maqueta.", "Contenido de prueba.", "Párrafo de ejemplo.", "Texto de muestra.", "Aquí va el texto.", "Escriba aquí su texto.",
    "Texte de remplissage pour la maquette.", "Contenu de test.", "Paragraphe d'exemple.", "Texte factice.", "Contenu fictif à remplacer.", "Le texte viendra ici.", "Votre texte ici.", "Ceci est un exemple de texte.", "Texte provisoire.", "Contenu provisoire.",
    "여기에 본문이 들어갈 자리입니다.", "이 자리에 글이 올 예정입니다.", "이 칸에 번역문이 나옵니다.", "여기에 해제가 표시됩니다.", "본문 내용을 입력하세요.", "예시 문장입니다.", "샘플 텍스트입니다.", "임시 글입니다.", "내용이 들어갑니다.",
    "ここに本文が入ります。", "この欄に訳文を入れてください。", "ここに解説の見本が表示されます。", "これはサンプルテキストです。", "ダミーの文章です。", "テキストが入ります。",
    "此处填写正文。", "这里显示示例内容。", "此处为占位文字。", "这里为占位文字。", "请在此输入内容。", "示例文本。", "測試文字。", "此處填寫正文。", "這裡顯示示例內容。", "此處為佔位文字。",
)

# Letters in the order of a keyboard row or of a list, which senseless text is typed from.
ALPHABETS = ("qwerty", "uiop", "asdfgh", "hjkl", "zxcvbnm", "ㅂㅈㄷㄱㅅㅛ", "ㅁㄴㅇㄹㅎㅗ", "ㅋㅌㅊㅍㅠㅜ", "가나다라마바사아", "자차카타파하", "甲乙丙丁戊己", "あいうえお", "アイウエオ", "かきくけこ", "いろはにほへと", "天地玄黄")

# Error pages and error messages.
ERRORS = (
    "Oops! That page can't be found.", "It looks like nothing was found at this location. Maybe try a search?", "This page isn't working right now.", "This site can't be reached.", "We're having trouble finding that site.", "The connection was reset.", "Sorry, the page you are looking for does not exist.", "We can't find the page you're looking for.",
    "The server encountered an internal error or misconfiguration and was unable to complete your request.", "The requested URL was not found on this server.", "You don't have permission to access this resource.", "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.", "Error establishing a database connection", "Service Temporarily Unavailable", "Gateway Time-out", "Application error: a client-side exception has occurred.", "Checking your browser before accessing the site.", "Please complete the security check to access this page.", "Unhandled exception", "Warning: access denied for user", "Notice: undefined index", "Parse error: syntax error, unexpected end of file", "This content is not available in your region.", "The link you followed may have expired.",
    "404 Not Found", "The page you requested could not be found.", "Page not found", "Document not found", "Record not found.", "Internal server error", "Bad gateway", "Service unavailable", "Access denied", "Forbidden", "Permission denied", "Request timed out", "Session expired", "Database connection failed", "Whoops, something broke", "Something went wrong.", "An unexpected error occurred.", "Oops, that did not work.",
    "The server could not complete your request.", "The index could not be reached.", "The gateway could not answer in time.", "The server is temporarily unavailable.", "The service is down for maintenance.", "Your document is restricted", "Your document is no longer available", "This record is no longer available", "The page has expired", "Your request could not be processed", "Your session has expired.", "You do not have permission to view this page.", "Please log in again.",
    "Please try again later.", "Please try again in a few minutes.", "Return to the front page.", "Go back to the catalogue.", "The address may be wrong.", "Check the address.", "It may have been removed or renamed.", "It may have been moved by its owner.", "The link may be broken.", "Request id", "Error code", "Reference number", "Contact the administrator.", "Too many requests", "The file is missing or unavailable",
    "Traceback (most recent call last):", "File \"view.py\", line 1, in show", "KeyError: 'page'", "ValueError: invalid value", "TypeError: 'NoneType' object", "java.lang.NullPointerException at Index.open", "java.lang.IllegalStateException at Viewer.load", "Exception in thread main", "Stack trace", "Fatal error: uncaught exception", "Segmentation fault", "Undefined variable", "at Loader.load", "RuntimeError", "IndexError: list index out of range", "lang.RuntimeException at Page.read",
    "Error del servidor", "Página no encontrada", "Ficha no encontrada", "Documento no disponible", "Acceso denegado", "La página solicitada no existe.", "Se ha producido un error.", "El servidor no responde.", "Inténtelo de nuevo más tarde.", "Vuelva a la página de inicio.", "Compruebe la dirección.", "La sesión ha caducado", "Servicio en mantenimiento", "Referencia", "No se pudo completar la solicitud.", "El documento ha sido retirado.", "Puede que se haya movido o eliminado.", "Contacte con el administrador.",
    "Erreur du serveur", "Page introuvable", "Document indisponible", "Notice introuvable", "Accès refusé", "La page demandée n'existe pas.", "Une erreur est survenue.", "Le serveur ne répond pas.", "Veuillez réessayer plus tard.", "Retour à l'accueil.", "Vérifiez l'adresse.", "La session a expiré", "Service en maintenance", "Référence", "La demande n'a pas abouti.", "Le document a été retiré ou déplacé.", "Contactez l'administrateur.",
    "오류가 발생하였습니다", "HTTP 오류", "페이지를 찾을 수 없습니다", "요청하신 자료를 찾을 수 없습니다.", "찾으시는 목록을 찾을 수 없습니다", "찾으시는 자료가 없거나 옮겨졌습니다", "선택한 문서가 없거나 옮겨졌습니다", "선택한 자료에 접근할 권한이 없습니다", "요청하신 화면을 불러오지 못했습니다", "선택한 페이지를 불러오지 못했습니다", "요청하신 페이지가 없습니다.", "존재하지 않는 문서입니다.", "접속이 제한되었습니다", "접근 권한이 없습니다", "세션이 만료되었습니다", "서비스 점검 중입니다", "서버에 연결할 수 없습니다.", "서버 응답이 없습니다.", "동시 접속자가 많아 연결이 지연되고 있습니다.", "잠시 후 다시 시도하여 주십시오.", "조금 뒤에 다시 접속해 주십시오.", "관리자에게 문의하십시오.", "담당자에게 문의하십시오.", "자료실에게 문의하십시오.", "이전 화면으로", "처음 화면으로 돌아가기", "주소를 다시 확인하십시오.", "주소가 바뀌었거나 삭제되었습니다.", "이름이 바뀌어 삭제된 문서입니다.", "기간이 지났거나 삭제된 원문입니다.", "요청 번호", "오류 번호", "불러오지 못하였습니다.", "데이터베이스 연결 실패", "요청을 처리하지 못하였습니다.", "다시 로그인하여 주십시오.", "비공개 자료입니다.", "자료가 이동되었거나 삭제되었을 수 있습니다.",
    "エラー", "ページが見つかりません", "お探しのページは見つかりませんでした。", "お探しの資料は移動または削除された可能性があります。", "アクセスが拒否されました", "アクセス権限がありません", "サーバーに接続できません", "サーバーエラーが発生しました", "しばらくしてからもう一度お試しください。", "アドレスを確認してください。", "トップページへ戻る", "セッションの有効期限が切れました", "メンテナンス中です", "管理者にお問い合わせください。", "番号", "資料を表示できません", "リクエストを処理できませんでした",
    "错误", "页面不存在", "找不到页面", "您访问的页面不存在或已删除。", "资料无法显示", "文档不存在", "访问被拒绝", "没有访问权限", "服务器错误", "服务器繁忙，请稍后再试。", "请稍后再试。", "请检查地址是否正确。", "返回首页", "会话已过期", "系统维护中", "请联系管理员。", "编号", "无法连接数据库", "该资料可能已被移动或删除。", "錯誤", "找不到頁面", "資料無法顯示", "請稍後再試。", "編號",
)

# Notices that scripts or the like are needed.
NOTICES = (
    "This page needs JavaScript; your browser has them switched off.", "This viewer needs scripts; your browser has support switched off.", "Please enable JavaScript to continue.", "JavaScript is disabled in your browser.", "You need to enable JavaScript to run this app.", "Enable cookies and reload the page.", "Your browser is not supported.", "Please turn on scripts and try again.", "Allow scripts in your browser to view this page.", "Switch on scripting to use this site.", "Turn on scripting to see this image.", "Scripting is required to read this document.", "Images need a browser with scripts enabled.", "Loading viewer ... if nothing appears, check that scripts are allowed.",
    "Active JavaScript en su navegador.", "Permita los scripts para continuar.", "Habilite JavaScript para ver esta página.", "Su navegador no admite scripts.", "Este sitio necesita JavaScript.",
    "Activez JavaScript dans votre navigateur.", "Autorisez les scripts pour continuer.", "Veuillez activer JavaScript pour afficher cette page.", "Votre navigateur ne prend pas en charge les scripts.", "Ce site nécessite JavaScript.",
    "스크립트가 꺼져 있어 내용을 표시할 수 없습니다.", "스크립트가 꺼져 있어 그림을 표시할 수 없습니다.", "JavaScript가 꺼져 있어 원문을 표시할 수 없습니다.", "스크립트 실행을 허용한 뒤 다시 시도하십시오.", "쿠키와 스크립트 실행을 허용한 뒤 다시 여십시오.", "원문을 보려면 자바스크립트를 허용해 주십시오.", "색인을 보려면 자바스크립트를 켜야 합니다.", "쪽 그림을 보려면 자바스크립트를 켠 뒤 새로 고침하십시오.", "자바스크립트를 사용할 수 없는 브라우저입니다.", "원문 이미지를 보려면 스크립트를 허용하십시오.",
    "このページの表示には JavaScript を有効にしてください。", "この資料の表示には スクリプト を許可してください。", "この画像の表示には JavaScript を許可してください。", "ブラウザの設定でスクリプトを有効にしてください。", "お使いのブラウザは対応していません。",
    "请启用浏览器 JavaScript 功能后重新加载。", "请打开浏览器脚本功能后再查看。", "请允许浏览器 JavaScript 功能后重新加载。", "您的浏览器不支持脚本。", "本页需要 JavaScript 才能显示。", "請啟用瀏覽器 JavaScript 功能後重新載入。",
)

# Headings and navigation of pages, which are no content.
NAVIGATION = (
    "원문 보기 | 검색 | 도움말", "목록 이전 다음", "원문 뷰어", "자료관", "Document viewer", "Home | Search | Help", "Previous Next", "목록으로", "처음으로", "ホーム 検索 ヘルプ", "首页 搜索 帮助", "Inicio | Buscar | Ayuda", "Accueil | Recherche | Aide", "로그인", "메뉴", "전자 도서관", "디지털 자료실",
)


def table() -> list[tuple[str, str]]:
    """(label, text) of the exemplars above: what residue_documents() takes if it is given none."""
    placeholders = [("short_placeholder" if p in SHORT else "placeholder", p) for p in PLACEHOLDERS]
    rest = {"filler": FILLER, "filler_letters": ALPHABETS, "error_page": ERRORS, "script_notice": NOTICES, "navigation": NAVIGATION}
    return placeholders + [(label, text) for label, texts in rest.items() for text in texts]
