"""Residue held out: texts written apart from the exemplars and from every table."""

import pytest

from loamworks.llm import residue as Z

HELD_OUT = [
    "Error 404: the page cannot be found. It may have been renamed or deleted.",
    "404\nThis page could not be found.",
    "The requested page could not be located on this server.",
    "Whoops, looks like something went wrong.",
    "Sorry, an error has occurred. Please go back and try again.",
    "We could not find the page you requested.",
    "This page is no longer available.",
    "500 Internal Server Error\nThe server has encountered an error and could not complete your request.",
    "The server is currently unable to handle the request. Please try again later.",
    "The website is under maintenance. Please check back soon.",
    "Service Temporarily Unavailable\nThe server is busy. Try again in a few minutes.",
    "You don't have access to this page. Please sign in.",
    "Access to this site has been blocked.",
    "Your request timed out. Please try again.",
    "You have made too many requests. Please try again later.",
    "Please wait while we are checking your browser.",
    "Please complete the security check to continue.",
    "Error code: 1020\nAccess denied\nYour IP has been blocked.",
    "We can't find the server at that address. Check your connection.",
    "Connection to the database could not be established.",
    "Traceback (most recent call last):\n  File \"app/main.py\", line 12, in <module>\nValueError: invalid literal for int() with base 10: 'x'",
    "java.lang.NullPointerException\n\tat com.shop.cart.Cart.total(Cart.java:88)\n\tat com.shop.Main.main(Main.java:12)",
    "Warning: Undefined variable $name in /var/www/html/page.php on line 31",
    "Fatal error: Uncaught Error: Call to undefined function connect() in /srv/www/db.php on line 7",
    "{\"error\": {\"code\": 503, \"message\": \"Service unavailable\"}}",
    "Your session has expired. Please log in again.",
    "This link has expired or is no longer valid.",
    "This video is not available in your country.",
    "La page que vous avez demandée n'existe pas.",
    "Une erreur s'est produite. Veuillez réessayer.",
    "El servidor no está disponible. Inténtelo de nuevo más tarde.",
    "No se ha encontrado la página que busca.",
    "Die Seite wurde leider nicht gefunden.",
    "Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.",
    "Your browser has JavaScript disabled. Turn it on to continue.",
    "This page needs JavaScript. Please enable it in your browser.",
    "JavaScript is turned off. Please turn it on and reload the page.",
    "You need to enable JavaScript to view this site.",
    "Please enable cookies and JavaScript in your browser.",
    "Ce site a besoin de JavaScript. Veuillez l'activer dans votre navigateur.",
    "Debe activar JavaScript en su navegador para ver el contenido.",
    "Bitte JavaScript im Browser aktivieren und die Seite neu laden.",
    "Diese Anwendung benötigt JavaScript.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
    "Curabitur mattis lectus dapibus, semper risus in, tincidunt ligula.",
    "Insert your title here\nAdd your text here",
    "This is sample text. Replace it with your own text.",
    "Placeholder text goes here.",
    "Content coming soon.",
    "Hier Ihren Text eingeben",
    "Insérez ici votre texte",
    "Escriba aquí su texto",
    "foo foo foo foo foo foo",
    "Dear {{customer.first_name}}, hi",
    "Hi ${firstName}, thank you for your order.",
    "Your booking on %%BOOKING_DATE%% is confirmed.",
    "Welcome back, [USERNAME]!",
    "Invoice for <%= client.company %> due on <%= due %>.",
    "Dear [Name], we hope you enjoyed your stay.",
]
REAL = [
    "The 404 page of our shop now shows the way to the new catalogue.",
    "Our server room was moved to the second floor in May.",
    "Lorem ipsum is the name of a text that printers have used since the sixteenth century.",
    "The clerk found an error in the third column and mended it.",
    "JavaScript was written in ten days, and the story is told in many books.",
    "We apologise to all guests who had to wait for their rooms on Friday.",
    "The gate to the garden is closed for maintenance until Easter.",
    "Access to the archive is by appointment; please bring your card.",
    "Please enable cookies if you want to keep your basket. The basket holds up to forty parts, and orders leave us the same day.",
    "Bread, cheese and two apples",
    "The page of the register that holds the year 1843 is missing.",
    "He said sorry and tried again.",
    "The request of the mill was refused by the council.",
    "La page deux du journal parle de la fête du village.",
    "El servidor de la cocina trajo el pan.",
    "Der Fehler lag im Motor der Pumpe.",
    "Copper wire, 12 rolls, in stock",
    "Hello, this is the second letter I write to you.",
    "Use {{ name }} in the template to print the name of the reader.",
    "The price in [brackets] holds for members.",
    "A set {a, b, c} has eight subsets.",
    "Costs rose by 5% and sales by 7% in the year.",
    "Temperatures of -5 to 3 degrees were measured at the bridge.",
    "Users asked how to turn on JavaScript, and we wrote a short guide with pictures for them.",
    "Opening hours\nMonday to Friday, nine to five",
    "Text follows the picture on each page of the almanac.",
    "The browser of the deer had eaten the bark of young trees.",
    "The list of dead links is checked every night and the owner gets a mail.",
    "Error bars show one standard deviation.",
    "Too many cooks spoil the broth.",
]


@pytest.fixture(scope="module")
def index():
    return Z.ResidueIndex({})


def test_held_out_recall(index):
    missed = [t for t in HELD_OUT if not Z.is_residue(t, index)]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed


def test_held_out_precision(index):
    wrong = [t for t in REAL if Z.is_residue(t, index)]
    assert len(wrong) <= 0.05 * len(REAL), wrong


def test_what_may_stand_around(index):
    around = ["Help | Shop | Jobs", "Marrow Tools, P.O. Box 8609, Eastmallow", "Marrow Tools, 2253 N. Tanner Road, Suite 40, Gullhaven, 00539", "Tel. 0049 (30) 23125906 / desk(at)marrow.example.org", "Follow Marrow Tools: board, feed, letter", "(c) 2020 Marrow Tools. All rights reserved."]
    assert all(Z.is_residue(f"{x}\nThis page could not be found.", index) for x in around)
    assert not any(Z.is_residue(x, index) for x in around)


def test_single_words_say_nothing(index):
    assert not any(Z.is_residue(t, index) for t in ("Server", "Code", "Mary Ann Lee", "One Two\nThree Four\nFive Six\nThis page could not be found"))
    assert Z.is_residue("Marrow Tools\nError\nThis page could not be found", index)
