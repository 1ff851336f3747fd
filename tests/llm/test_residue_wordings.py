"""Residue in wordings that no example has, with and without the examples of its family."""

import random

import pytest

from moorgrid.llm import residue as R
from moorgrid.llm import residue_examples as X

# Written for this test: none is an example, none is taken from the tables.
UNSEEN = {
 "missing": ["We looked everywhere but this page does not seem to exist.","Nothing was found under this address.","Error 404: the resource you asked for is gone.","Sorry, we could not find that page.","Dieses Dokument konnte leider nicht gefunden werden.","Oups, cette page n'existe pas.","No hemos encontrado la página que busca.","Não encontrámos o documento pedido.","Non riusciamo a trovare la pagina richiesta.","К сожалению, такой страницы не существует."],
 "failure": ["Something went wrong on our side while loading this page.","The server reported an unexpected error.","Oops, an error occurred. Please reload.","HTTP 500 - the request could not be processed.","Es ist ein unerwarteter Fehler aufgetreten.","Une erreur est survenue lors du chargement.","Se produjo un error al procesar su solicitud.","Ocorreu um erro ao carregar a página.","Si è verificato un errore durante la richiesta.","При загрузке страницы произошла ошибка."],
 "unavailable": ["This website is down for scheduled maintenance.","Service temporarily unavailable, please come back later.","The server is too busy right now, try again in a few minutes.","502 - bad answer from the upstream server","Der Server ist zurzeit wegen Wartung nicht erreichbar.","Ce service est momentanément indisponible.","El servidor no está disponible en este momento.","O serviço está temporariamente fora de serviço.","Il servizio non è al momento disponibile.","Сервис временно не работает, попробуйте позже."],
 "timeout": ["The server took too long to answer.","Your connection was lost before the page had loaded.","Gateway timeout: the upstream did not respond.","The request has timed out, reload the page.","Zeitlimit für die Anfrage an den Server überschritten.","Le serveur a mis trop de temps à répondre.","La conexión con el servidor ha caducado.","A ligação ao servidor foi perdida.","Il server ha impiegato troppo tempo a rispondere.","Сервер слишком долго не отвечает на запрос."],
 "denied": ["You need to log in before you can view this page.","You are not allowed to see this document.","403 Forbidden - insufficient permissions","Members only. Please sign in to continue.","Sie haben keine Berechtigung, diese Seite zu öffnen.","Vous n'êtes pas autorisé à voir cette page.","No tiene permiso para ver esta página.","Não tem permissão para ver esta página.","Non hai il permesso di vedere questa pagina.","У вас нет прав на просмотр этой страницы."],
 "scripts": ["JavaScript must be enabled to use this application.","Your browser has scripts turned off; allow them to continue.","This site cannot be displayed without JavaScript.","We need cookies and scripts to show this page.","Zum Anzeigen dieser Seite muss JavaScript erlaubt sein.","JavaScript est nécessaire pour afficher ce site.","Debe habilitar JavaScript en su navegador.","É necessário ativar o JavaScript no navegador.","Per visualizzare il sito occorre abilitare JavaScript.","Для просмотра сайта включите JavaScript в браузере."],
 "crash": ["Unhandled exception: IndexError: list index out of range","Traceback (most recent call last): File \"app.py\", line 88, in render","Fatal error: cannot connect to the database","TypeError: unsupported operand in template line 14","SQL error: no such table pages","Warning: include(header.php): failed to open stream","Exception in thread main: null pointer","OperationalError: database disk image is malformed"],
 "loading": ["Please wait while we load the content...","Loading the page, one moment please","You are being redirected to another page.","We are checking your browser before you continue.","Bitte warten, die Seite wird gerade geladen.","Veuillez patienter pendant le chargement de la page.","Espere mientras se carga la página...","Aguarde, a página está a carregar.","Attendere, caricamento della pagina in corso","Подождите, идёт загрузка страницы."],
 "put here": ["Type your own heading here","Put a short text about yourself here.","Your greeting to visitors here","Enter the name of your site here","Bitte hier Ihren eigenen Text eintragen","Ajoutez ici votre description","Escriba aquí el nombre de su sitio","Escreva aqui a sua mensagem","Inserisci qui la tua descrizione","Напишите здесь свой заголовок"],
 "goes here": ["Your greeting goes here","The name of your node belongs here.","Hier steht später Ihre Begrüßung","Votre présentation va ici","Su saludo va aquí","A sua saudação entra aqui","Il tuo saluto va qui","Здесь должно быть приветствие"],
 "example only": ["This is sample text, change it.","This page is just a template, please edit it.","Remember to replace this example with your own words","Dies ist nur ein Beispieltext, bitte ändern","Ceci est un texte d'exemple à remplacer","Este texto es un ejemplo, cámbielo por el suyo","Questo testo è un modello da sostituire","Это образец текста, замените его на свой"],
 "in brackets": ["[insert your address]","<enter site name>","[ADD YOUR LOGO]","(put your name)","[Adresse eintragen]","[insérer votre nom]","[inserte la fecha]","[вставьте название]"],
 "change": ["Replace this paragraph with your own introduction.","Edit this section before you publish the page","Delete this example text when done.","Please change this sentence to your own.","Bitte diesen Absatz durch Ihren eigenen ersetzen","Remplacez ce paragraphe par votre propre texte","Cambie este párrafo por su propio texto","Substitua este parágrafo pelo seu próprio texto","Sostituisci questo paragrafo con il tuo testo","Замените этот абзац своим текстом"],
 "to do": ["TODO: add a picture of the station","FIXME: explain how to join","TBD: describe the antenna","TODO write the introduction","XXX: add the missing link","Note to author: complete this section"],
 "mixed": ["dolore magna ipsum sit veniam nostrud tempor elit laboris","consequat aliqua sed ut dolor quis nisi lorem exercitation","Ut labore dolor amet, cupidatat sunt officia velit ipsum","sed ut perspiciatis lorem ipsum dolor consectetur adipiscing"],
 "repeated": ["words and words and words and words and words and","words words words words words words","probe probe probe probe probe probe probe","hello hello hello hello hello hello hello","lipsum lipsum lipsum lipsum lipsum","foo foo foo foo foo foo foo foo"],
}

PROSE_WORDS = "relay router bridge hill bay stores hides sorts evening shared report channel storm upgrade meeting harbour wire summer valley keeper boats winter radio garden notes letters morning lantern".split()


def prose(r):
    return ". ".join("The " + " ".join(r.sample(PROSE_WORDS, 9)) for _ in range(8)) + "."


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    return [prose(r) for _ in range(300)]


def share(model, wordings):
    return sum(R.judge(w, model)[0] is not None for w in wordings) / len(wordings)


def test_no_wording_is_an_example():
    lines = {x.lower() for ls in R.examples().values() for x in ls}
    assert not [w for ws in UNSEEN.values() for w in ws if w.lower().rstrip(".") in lines]
    assert set(UNSEEN) == {*X.NOTICES, *X.INSTRUCTIONS, "mixed", "repeated"} - {"advice"}


def test_unseen_wordings_are_found(texts):
    model = R.fit(texts, [])
    assert share(model, [w for ws in UNSEEN.values() for w in ws]) >= 0.9
    r = random.Random(4)
    assert share(model, [prose(r) for _ in range(300)]) == 0


def test_wordings_of_a_family_without_any_example(texts):
    got = {f: share(R.fit(texts, [], without=f), ws) for f, ws in UNSEEN.items()}
    print({f: round(x, 2) for f, x in got.items()}, round(sum(got[f] * len(UNSEEN[f]) for f in got) / sum(map(len, UNSEEN.values())), 3))
    assert sum(got[f] * len(UNSEEN[f]) for f in got) / sum(map(len, UNSEEN.values())) >= 0.9
