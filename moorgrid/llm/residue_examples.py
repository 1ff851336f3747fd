"""Examples of residue, made by rules: every family is a few lists of phrases whose combinations are its lines.

A family is one kind of message in all languages. What an operator of another site would write is
not known, so the lists hold the common words of such messages rather than messages of any one site;
families share words (page, server, reload, please), which is what lets a model find messages of a
family that it has no example of.
"""

from __future__ import annotations

from itertools import product

# Phrases of error pages and script notices by family; each tuple of lists is combined (fixed values).
NOTICES: dict[str, list[tuple[list[str], ...]]] = {
    "missing": [
        (["the page", "this page", "the document", "the file", "that address", "the article", "the requested resource", "the content", "the url", "what you are looking for"], ["was not found", "does not exist", "could not be found", "cannot be found", "is no longer available", "has been deleted", "is not on this server", "was removed"]),
        (["error 404", "404:", "http 404", "sorry,", "status 404 -", "410 gone:"], ["not found", "nothing here", "page missing", "no document at this address", "file not found", "the link is broken", "page does not exist", "unknown page", "no such document"]),
        (["die Seite", "das Dokument", "die Datei", "die angeforderte Adresse", "dieser Inhalt"], ["wurde nicht gefunden", "existiert nicht", "konnte nicht gefunden werden", "ist nicht mehr verfügbar", "wurde gelöscht", "gibt es nicht"]),
        (["la page", "le document", "le fichier", "l'adresse demandée", "ce contenu"], ["est introuvable", "n'existe pas", "n'a pas été trouvé", "n'existe plus", "n'est plus disponible", "a été supprimé"]),
        (["la página", "el documento", "el archivo", "la dirección solicitada", "el contenido"], ["no existe", "no se encuentra", "no se ha encontrado", "no fue encontrada", "ya no está disponible", "ha sido eliminado"]),
        (["a página", "o documento", "o ficheiro", "o endereço pedido", "o conteúdo"], ["não existe", "não foi encontrada", "não foi encontrado", "já não está disponível", "foi removido"]),
        (["la pagina", "il documento", "il file", "l'indirizzo richiesto", "il contenuto"], ["non esiste", "non è stata trovata", "non è stato trovato", "non è più disponibile", "è stato rimosso", "inesistente"]),
        (["запись", "документ", "файл", "запрошенный адрес", "запрашиваемая запись", "такой страницы", "материал"], ["не найден", "не найдена", "не существует", "нет на сервере", "больше не доступна", "был удалён", "отсутствует"]),
        (["сторінка", "документ", "файл", "запитана адреса", "такої сторінки", "матеріал"], ["не знайдено", "не знайдена", "не існує", "немає на сервері", "більше не доступна", "було видалено", "відсутня"]),
    ],
    "failure": [
        (["the server", "the application", "this service", "our system", "the script", "the program"], ["encountered an error", "has failed", "failed to complete your request", "crashed", "returned an error", "ran into an unexpected problem", "could not process the request", "stopped with an exception"]),
        (["error", "fatal error", "server error", "internal error", "unexpected error", "http 500", "status 500", "error 500", "application error"], ["something broke", "while processing the request", "an exception occurred", "the operation failed", "no data returned", "unable to display this page", "could not load the page", "please contact the administrator"]),
        (["ein interner Fehler", "ein unerwarteter Fehler", "ein Serverfehler", "Fehler 500:", "beim Laden der Seite ist ein Fehler"], ["ist aufgetreten", "auf dem Server", "der Vorgang ist fehlgeschlagen", "die Seite kann nicht angezeigt werden", "die Anfrage konnte nicht verarbeitet werden"]),
        (["une erreur interne", "une erreur inattendue", "une erreur du serveur", "erreur 500 :"], ["s'est produite", "est survenue", "impossible d'afficher la page", "l'opération a échoué", "la requête n'a pas abouti"]),
        (["un error interno", "un error inesperado", "error del servidor", "error 500:"], ["ha ocurrido", "se ha producido", "no se puede mostrar la página", "la operación ha fallado", "no se pudo procesar la solicitud"]),
        (["um erro interno", "um erro inesperado", "erro do servidor", "erro 500:"], ["ocorreu", "aconteceu", "não é possível mostrar a página", "a operação falhou", "não foi possível processar o pedido"]),
        (["un errore interno", "un errore imprevisto", "errore del server", "errore 500:"], ["si è verificato", "impossibile mostrare la pagina", "l'operazione non è riuscita", "la richiesta non è andata a buon fine"]),
        (["внутренняя ошибка", "непредвиденная ошибка", "ошибка сервера", "ошибка 500:", "произошла ошибка"], ["на сервере", "при обработке запроса", "не удалось показать страницу", "не удалось загрузить страницу", "операция не выполнена"]),
        (["внутрішня помилка", "неочікувана помилка", "помилка сервера", "помилка 500:", "сталася помилка"], ["на сервері", "під час обробки запиту", "не вдалося показати сторінку", "не вдалося завантажити сторінку", "операцію не виконано"]),
    ],
    "unavailable": [
        (["the site", "this service", "the server", "the website", "this system"], ["is temporarily unavailable", "is offline", "is currently down", "is under maintenance", "is being updated", "is overloaded", "cannot be reached", "will be back soon"]),
        (["error 503", "503", "http 502", "502", "504", "sorry,"], ["service unavailable", "bad gateway", "gateway error", "invalid response from upstream", "scheduled maintenance", "too many requests", "try again in a few minutes", "come back later"]),
        (["die Seite ist", "der Dienst ist", "der Server ist"], ["vorübergehend nicht erreichbar", "zurzeit nicht verfügbar", "wegen Wartung geschlossen", "überlastet", "gerade offline"]),
        (["le site est", "le service est", "le serveur est"], ["temporairement indisponible", "en maintenance", "hors ligne", "surchargé", "actuellement inaccessible"]),
        (["el sitio está", "el servicio está", "el servidor está"], ["temporalmente no disponible", "en mantenimiento", "fuera de línea", "sobrecargado", "fuera de servicio"]),
        (["o site está", "o serviço está", "o servidor está"], ["temporariamente indisponível", "em manutenção", "fora do ar", "sobrecarregado"]),
        (["il sito è", "il servizio è", "il server è"], ["temporaneamente non disponibile", "in manutenzione", "non raggiungibile", "sovraccarico"]),
        (["сайт", "сервис", "сервер"], ["временно недоступен", "на обслуживании", "не отвечает", "перегружен", "закрыт на технические работы"]),
        (["сайт", "сервіс", "сервер"], ["тимчасово недоступний", "на обслуговуванні", "не відповідає", "перевантажений", "закрито на технічні роботи"]),
    ],
    "timeout": [
        (["the request", "the connection", "the operation", "your session", "the server", "the link", "the transfer"], ["timed out", "took too long", "has expired", "did not respond in time", "was interrupted", "was lost", "was reset", "was closed before it finished", "gave no answer within 60 seconds"]),
        (["timeout:", "error 504:", "408", "network error:", "connection error:"], ["no response", "no answer from the server", "waiting time exceeded", "try reloading the page", "could not connect", "the host does not answer", "gateway timeout", "request timeout"]),
        (["die Verbindung", "die Anfrage", "der Server", "die Wartezeit"], ["wurde unterbrochen", "ist abgelaufen", "hat zu lange gedauert", "antwortet nicht", "wurde überschritten", "wurde getrennt"]),
        (["la connexion", "la requête", "le serveur", "le délai d'attente"], ["a été interrompue", "a expiré", "a pris trop de temps", "ne répond pas", "est dépassé", "a été perdue"]),
        (["la conexión", "la solicitud", "el servidor", "el tiempo de espera"], ["se ha interrumpido", "ha caducado", "ha tardado demasiado", "no responde", "se ha agotado", "se ha perdido"]),
        (["a ligação", "o pedido", "o servidor", "o tempo de espera"], ["foi interrompida", "expirou", "demorou demasiado", "não responde", "foi excedido", "esgotou-se"]),
        (["la connessione", "la richiesta", "il server", "il tempo di attesa"], ["è stata interrotta", "è scaduta", "ha impiegato troppo tempo", "non risponde", "è scaduto", "è stato superato"]),
        (["соединение", "запрос", "сервер", "время ожидания"], ["прервано", "истекло", "выполнялся слишком долго", "не отвечает", "вышло", "потеряно", "ответа превышено"]),
        (["з'єднання", "запит", "сервер", "час очікування"], ["перервано", "минув", "виконувався надто довго", "не відповідає", "вийшов", "втрачено", "відповіді перевищено"]),
    ],
    "denied": [
        (["access", "entry", "this page"], ["denied", "is forbidden", "rejected", "requires a login", "is restricted", "is for members only", "not allowed", "needs authorization"]),
        (["you are not authorized", "you do not have permission", "you must be logged in", "please sign in", "please log in", "identification required", "you need an account", "authentication failed:"], ["to view this page", "to open this document", "to continue", "to see this content", "wrong password", "before reading this"]),
        (["403", "401", "error 403:", "error 401:"], ["forbidden", "unauthorized", "access denied", "login required", "no permission", "not permitted"]),
        (["Zugang", "der Zugriff auf diese Seite", "die Anmeldung"], ["verweigert", "gesperrt", "nicht erlaubt", "ist erforderlich", "nur für Mitglieder", "bitte melden Sie sich an"]),
        (["accès", "l'accès à cette page", "cette page"], ["non permis", "interdit", "est réservé aux membres", "veuillez vous connecter", "n'est pas autorisé", "demande une identification"]),
        (["acceso", "el acceso a esta página"], ["denegado", "prohibido", "no está permitido", "solo para miembros", "inicie sesión para continuar", "requiere identificación"]),
        (["acesso", "o acesso a esta página"], ["negado", "proibido", "não é permitido", "só para membros", "inicie sessão para continuar", "exige identificação"]),
        (["accesso", "l'accesso a questa pagina"], ["negato", "vietato", "non è consentito", "riservato ai membri", "accedi per continuare", "richiede l'identificazione"]),
        (["доступ", "доступ к этой странице", "вход"], ["не разрешён", "закрыт", "ограничен", "только для участников", "войдите в систему", "требует авторизации"]),
        (["доступ", "доступ до цієї сторінки", "вхід"], ["заборонено", "закрито", "обмежено", "лише для учасників", "увійдіть у систему", "потребує авторизації"]),
    ],
    "scripts": [
        (["this site", "this page", "the application", "this content", "the reader", "this view"], ["requires javascript", "needs javascript to run", "only works with scripts enabled", "does not work without javascript", "cannot be shown without scripts", "relies on scripts and cookies", "requires a newer browser"]),
        (["javascript", "scripting", "script support", "cookies"], ["is disabled", "is turned off in your browser", "must be enabled", "must be switched on", "is required", "is not available in your client", "have to be allowed"]),
        (["please", "you must", "you have to", "to continue,"], ["activate javascript", "turn on javascript", "switch on scripts", "allow scripts", "allow cookies", "activate scripting and reload", "use a client that runs scripts", "update your browser"]),
        (["JavaScript", "Skripte", "diese Anwendung"], ["ist deaktiviert", "muss eingeschaltet sein", "müssen erlaubt werden", "bitte einschalten", "benötigt JavaScript", "funktioniert nicht ohne Skripte", "wird von Ihrem Browser nicht ausgeführt"]),
        (["JavaScript", "les scripts", "ce site"], ["est désactivé", "doit être activé", "doivent être autorisés", "activez-les dans votre navigateur", "nécessite JavaScript", "ne fonctionne pas sans scripts", "a besoin de scripts"]),
        (["JavaScript", "los scripts", "este sitio"], ["está desactivado", "debe estar activado", "deben estar permitidos", "habilítelos en su navegador", "requiere JavaScript", "no funciona sin scripts", "necesita scripts"]),
        (["JavaScript", "os scripts", "este site"], ["está desativado", "tem de estar ativado", "têm de ser permitidos", "ative-os no navegador", "requer JavaScript", "não funciona sem scripts", "precisa de scripts"]),
        (["JavaScript", "gli script", "questo sito"], ["è disattivato", "deve essere attivato", "devono essere consentiti", "abilitali nel browser", "richiede JavaScript", "non funziona senza script", "ha bisogno di script"]),
        (["JavaScript", "скрипты", "этот сайт"], ["отключён", "должен быть включён", "должны быть разрешены", "включите в браузере", "требует JavaScript", "не работает без скриптов", "нужны скрипты"]),
        (["JavaScript", "скрипти", "цей сайт"], ["вимкнено", "має бути увімкнено", "мають бути дозволені", "увімкніть у браузері", "потребує JavaScript", "не працює без скриптів", "потрібні скрипти"]),
    ],
    "crash": [
        (["uncaught exception", "traceback (most recent call last):", "stack trace:", "segmentation fault", "assertion failed", "panic:"], ["TypeError: 'None' object is not callable", "ValueError: invalid literal", "NameError: name is not defined", "KeyError", "AttributeError: object has no attribute", "in main, line 40", "File \"index.py\", line 7, in run", "ImportError: no module named template", "null pointer", "OSError: no such file or directory"]),
        (["database error:", "sqlite error:", "disk error:", "warning:", "fatal:"], ["table is locked", "could not open the database", "unable to connect", "disk full", "query failed", "undefined variable in template", "insufficient rights", "cannot read the file", "syntax error near line 3"]),
    ],
    "loading": [
        (["loading", "please wait", "one moment", "just a moment", "redirecting", "checking your browser", "verifying that you are human"], ["...", "while the page loads", "the content is being loaded", "you will be redirected shortly", "this may take a few seconds", "if you are not redirected, follow the link", "before you continue", "your client is being checked", "do not close this window"]),
        (["this page has", "the document has", "this site has"], ["moved to a new address", "moved permanently", "been relocated", "changed its address, update your bookmarks"]),
        (["wird geladen", "bitte warten", "einen Augenblick bitte", "Sie werden weitergeleitet"], ["...", "die Seite wird aufgebaut", "der Inhalt wird geladen", "die Seite ist umgezogen"]),
        (["chargement en cours", "veuillez patienter", "redirection en cours"], ["...", "la page se charge", "cette page a changé d'adresse"]),
        (["cargando", "espere un momento", "redirigiendo"], ["...", "la página se está cargando", "esta página ha cambiado de dirección"]),
        (["a carregar", "aguarde por favor", "a redirecionar"], ["...", "a página está a ser carregada", "esta página mudou de endereço"]),
        (["caricamento in corso", "attendere prego", "reindirizzamento"], ["...", "la pagina è in caricamento", "questa pagina ha cambiato indirizzo"]),
        (["загрузка", "подождите, пожалуйста", "идёт перенаправление"], ["...", "страница загружается", "страница переехала"]),
        (["завантаження", "зачекайте, будь ласка", "триває перенаправлення"], ["...", "сторінка завантажується", "сторінка переїхала"]),
    ],
    "advice": [
        (["please", "you can", "try to", "if the problem persists,"], ["try again later", "reload the page", "refresh your browser", "go back to the start page", "check the address", "contact the operator", "come back soon", "report this error"]),
        (["bitte", "Sie können", "falls das Problem weiter besteht,"], ["versuchen Sie es später erneut", "laden Sie die Seite neu", "prüfen Sie die Adresse", "wenden Sie sich an den Betreiber"]),
        (["veuillez", "merci de", "si le problème persiste,"], ["réessayer plus tard", "recharger la page", "vérifier l'adresse", "contacter l'administrateur"]),
        (["por favor", "intente", "si el problema continúa,"], ["inténtelo más tarde", "vuelva a cargar la página", "compruebe la dirección", "póngase en contacto con el administrador"]),
        (["por favor", "se o problema continuar,"], ["tente novamente mais tarde", "recarregue a página", "verifique o endereço", "contacte o administrador"]),
        (["per favore", "se il problema persiste,"], ["riprova più tardi", "ricarica la pagina", "controlla l'indirizzo", "contatta l'amministratore"]),
        (["пожалуйста", "если ошибка повторяется,"], ["попробуйте позже", "обновите страницу", "проверьте адрес", "обратитесь к администратору"]),
        (["будь ласка", "якщо помилка повторюється,"], ["спробуйте пізніше", "оновіть сторінку", "перевірте адресу", "зверніться до адміністратора"]),
    ],
}

# Notes to the author of a page by family (fixed values).
INSTRUCTIONS: dict[str, list[tuple[list[str], ...]]] = {
    "put here": [
        (["insert", "put", "add", "enter", "type", "write", "paste", "place"], ["your text", "your own text", "a title", "the heading", "your name", "the name", "an address", "a picture", "an image", "a caption", "a short description", "the content", "some text", "your message", "contact details"], ["here", "in this place"]),
        (["hier", "an dieser Stelle"], ["Ihren Text", "Ihren Namen", "den Titel", "eine Überschrift", "ein Bild", "die Adresse", "eine kurze Beschreibung", "eigenen Text", "den Inhalt"], ["einfügen", "eintragen", "eingeben", "einsetzen", "schreiben"]),
        (["insérez", "ajoutez", "écrivez", "saisissez", "mettez"], ["votre texte", "votre nom", "le titre", "une image", "l'adresse", "une description", "le contenu"], ["ici"]),
        (["inserte", "escriba", "añada", "ponga", "introduzca"], ["su texto", "su nombre", "el título", "una imagen", "la dirección", "una descripción", "el contenido"], ["aquí"]),
        (["insira", "escreva", "adicione", "coloque", "introduza"], ["o seu texto", "o seu nome", "o título", "uma imagem", "o endereço", "uma descrição", "o conteúdo"], ["aqui"]),
        (["inserisci", "scrivi", "aggiungi", "metti", "inserire"], ["il testo", "il tuo nome", "il titolo", "un'immagine", "l'indirizzo", "una descrizione", "il contenuto"], ["qui"]),
        (["вставьте", "введите", "добавьте", "напишите", "впишите"], ["свой текст", "ваш текст", "имя", "название", "заголовок", "адрес", "описание", "картинку"], ["сюда", "здесь"]),
        (["вставте", "введіть", "додайте", "напишіть", "впишіть"], ["свій текст", "ваш текст", "ім'я", "назву", "заголовок", "адресу", "опис", "картинку"], ["сюди", "тут"]),
    ],
    "goes here": [
        (["your", "your own", "the", "a short"], ["paragraph", "title", "heading", "description", "content", "message", "name", "picture", "logo", "slogan", "introduction", "station name"], ["goes here", "comes here", "belongs here", "here", "go here"]),
        (["hier kommt", "hier steht", "hier folgt"], ["der Text hin", "später der Text", "dein Titel", "Ihr Name", "die Beschreibung", "Ihre Beschreibung", "eine Überschrift", "eigener Inhalt"]),
        (["votre texte", "votre titre", "votre nom", "votre message", "votre description", "le contenu"], ["va ici", "vient ici", "se place ici", "sera ici"]),
        (["su texto", "su título", "su nombre", "su mensaje", "su descripción", "el contenido"], ["va aquí", "irá aquí", "se pone aquí"]),
        (["o seu texto", "o seu título", "o seu nome", "a sua mensagem", "a sua descrição"], ["fica aqui", "entra aqui", "vem aqui"]),
        (["il tuo testo", "il tuo titolo", "il tuo nome", "il tuo messaggio", "la tua descrizione"], ["va messo qui", "viene qui", "sta qui"]),
        (["здесь появится", "здесь должен быть", "здесь должно быть", "тут з'явиться", "тут має бути"], ["ваш текст", "текст", "описание", "заголовок", "опис", "название", "назва", "сообщение"]),
    ],
    "example only": [
        (["this is", "this page is", "this text is", "this paragraph is", "the following is"], ["only an example", "just a sample", "a placeholder", "sample content", "a template, change it", "default content, please edit", "a dummy entry", "an empty page, add your text"]),
        (["do not forget to", "remember to", "you should", "please"], ["change this text", "replace the example", "add your own description", "write your own introduction", "remove the sample", "edit this section", "put your name in the title", "fill in the form", "insert a real address"]),
        (["dies ist nur", "das ist nur", "dieser Text ist"], ["ein Beispiel", "ein Platzhalter", "ein Muster, bitte ändern", "eine Vorlage, bitte ersetzen", "ein Beispiel, bitte durch eigenen Text ersetzen"]),
        (["ceci est", "ce texte est", "ce paragraphe est"], ["un exemple", "un exemple à remplacer", "un modèle à modifier", "un texte provisoire, remplacez-le", "à compléter par votre texte"]),
        (["esto es", "este texto es", "este párrafo es"], ["un ejemplo", "un ejemplo, cámbielo", "una plantilla, escriba su texto", "provisional, sustitúyalo por el suyo"]),
        (["isto é", "este texto é", "este parágrafo é"], ["um exemplo", "um exemplo, altere-o", "um modelo, escreva o seu texto", "provisório, substitua-o pelo seu"]),
        (["questo è", "questo testo è", "questo paragrafo è"], ["un esempio", "un esempio, modificalo", "un modello, scrivi il tuo testo", "provvisorio, sostituiscilo con il tuo"]),
        (["это", "этот текст", "этот абзац"], ["только пример", "образец, замените его", "шаблон, напишите свой текст", "временный, замените на свой"]),
        (["це", "цей текст", "цей абзац"], ["лише приклад", "зразок, замініть його", "шаблон, напишіть свій текст", "тимчасовий, замініть на свій"]),
    ],
    "change": [
        (["replace", "change", "edit", "rewrite", "remove", "delete", "fill in", "complete"], ["this row", "this text", "this paragraph", "this section", "this sentence", "this example", "this part", "the text in brackets"], ["with your own", "before publishing", "with real content", "later", "when the page is ready"]),
        (["diese Zeile", "diesen Text", "diesen Absatz", "dieses Beispiel"], ["bitte ersetzen", "durch eigenen Inhalt ersetzen", "vor der Veröffentlichung löschen", "bitte ändern", "noch ausfüllen"]),
        (["remplacez", "modifiez", "supprimez", "complétez"], ["ce texte", "ce paragraphe", "cette section", "cet exemple"], ["par le vôtre", "avant de publier"]),
        (["sustituya", "cambie", "borre", "complete"], ["este texto", "este párrafo", "esta sección", "este ejemplo"], ["por el suyo", "antes de publicar"]),
        (["substitua", "altere", "apague", "complete"], ["este texto", "este parágrafo", "esta secção", "este exemplo"], ["pelo seu", "antes de publicar"]),
        (["sostituisci", "modifica", "cancella", "completa"], ["questo testo", "questo paragrafo", "questa sezione", "questo esempio", "questa riga"], ["con il tuo", "prima di pubblicare"]),
        (["замените", "измените", "удалите", "заполните"], ["этот текст", "этот абзац", "этот раздел", "этот пример"], ["на свой", "перед публикацией"]),
        (["замініть", "змініть", "видаліть", "заповніть"], ["цей текст", "цей абзац", "цей розділ", "цей приклад"], ["на свій", "перед публікацією"]),
    ],
    "to do": [
        (["TODO:", "TODO -", "TODO", "FIXME:", "TBD:", "XXX:", "to do:", "note to self:", "note to author:", "author:"], ["write an introduction", "add a description", "describe the station", "explain this", "finish this section", "write more", "add the opening hours", "fill in the details", "replace the picture", "expand this paragraph", "insert the link", "add content", "complete the list", "say who runs this", "translate this text"]),
    ],
    "in brackets": [
        (["[", "<", "("], ["your name", "your address", "your site", "insert title", "add picture", "insert date", "insert link", "add text", "your callsign or name", "site name here", "enter text", "add your text", "insert the name of the station", "Titel einfügen", "Bild einfügen", "Namen eintragen", "insérer l'image", "insérer le titre", "insertar imagen", "inserte el título", "inserir imagem", "insira o título", "inserire immagine", "inserire il titolo", "вставить картинку", "вставьте заголовок", "вставити картинку", "вставте заголовок"], ["]", ">", ")"]),
    ],
}

# Filler (fixed values): the classic text is of the first century; the rest are words repeated.
CLASSIC = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."""
REPEATED = ["lorem ipsum", "dummy", "filler", "placeholder", "sample text", "example text", "text", "test", "testing", "blah", "bla", "foo bar", "foo bar baz", "asdf", "qwerty", "xxx", "abc abc", "content", "blindtext", "beispieltext", "mustertext", "platzhalter", "exemple", "texte", "ejemplo", "texto", "exemplo", "esempio", "testo", "prova", "текст", "тест", "проба", "пример", "приклад", "зразок", "рыба", "риба"]

# Texts that talk about templates and errors (fixed values).
TALK = """In the course at the village we write the name into the template and the builder puts the real name there.
The guide says that a text such as this on a page means the variable was never set.
For example, the macro prints the heading, and the filter after it cuts it at 20 letters.
The chapter about lorem ipsum explains why designers fill 20 drafts with it.
If you see internal error 500, restart the page server and read the log, as the operator advises.
When the node answered with error 404 last week, the reason was a renamed folder, and the operator wrote it down.
We do not use JavaScript on this node, because plain pages need 20 times less air time.
The placeholder in the template is replaced by the variable when the page is built.
A message such as page not found means that the folder was renamed.
The template engine writes the value of the variable in place of the braces.
Unser Kurs erklärt, wie die Vorlage den Platzhalter ersetzt. Die Anleitung sagt, dass ein solcher Text bedeutet, dass die Variable nie gesetzt wurde.
Le guide explique comment le modèle remplace la variable. El curso explica cómo la plantilla sustituye la variable. O guia explica como o modelo substitui a variável. La guida spiega come il modello sostituisce la variabile.
Руководство объясняет, как шаблон заменяет переменную. Посібник пояснює, як шаблон замінює змінну."""


def lines(families: dict[str, list[tuple[list[str], ...]]], without: str | None = None) -> list[str]:
    """All combinations of the families but one."""
    return [" ".join(c) for name, groups in families.items() if name != without for g in groups for c in product(*g)]


def stems(text: str, size: int = 6) -> list[str]:
    """The words of a text cut to their beginnings, as generators of filler do."""
    return list(dict.fromkeys(w.strip(".,").lower()[:size] for w in text.split()))


def filler(without: str | None = None) -> list[str]:
    """Classic filler, its words in other orders and cut, and repeated words."""
    ws = [w.strip(".,").lower() for w in CLASSIC.split()]
    mixed = [" ".join(ws[i::k]) for k in (3, 5, 7) for i in range(k)] if without != "mixed" else []
    cut = [" ".join(stems(CLASSIC, k)[i::2]) for k in (5, 6) for i in range(2)] if without != "cut" else []
    return [CLASSIC, *mixed, *cut, *([" ".join([w] * 6) for w in REPEATED] if without != "repeated" else [])]
