"""Labels on wording that stands neither in the templates nor in the tables: recall and precision of each."""

import os
import random

import pytest

from pelorus.llm.pairs import LABELS, fit, training_sample
from pelorus.sources.tables import table

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

WHOLE = [
    ("Why do bakers let dough rest?", "Resting gives the gluten time to relax, so the dough is easier to roll and holds its shape in the oven."),
    ("Name two uses of vinegar in a kitchen.", "It cuts through grease on a pan, and it keeps sliced apples from turning brown."),
    ("How does a lock on a canal work?", "Gates close at both ends, water is let in or out until the levels match, and then the boat moves on."),
    ("What is a ledger in accounting?", "A ledger is the book in which every account of a firm has its own page of debits and credits."),
    ("Write a line to thank a colleague for covering a shift.", "Thank you for stepping in on Friday; you saved my weekend and I owe you one."),
    ("Which planet has the shortest year?", "Mercury goes around the sun in 88 days, which is less than any other planet needs."),
    ("Is glass recyclable?", "Yes, and it can be melted again and again without losing quality."),
    ("Explain to a child what a bridge is for.", "A bridge lets people and cars cross a river or a road without getting wet or having to stop."),
    ("Turn this into a polite note: shut the door.", "Would you kindly close the door behind you? It keeps the room warm."),
    ("Summarise: the shop opens late on Mondays because deliveries come then.", "On Mondays the shop opens later than usual, as that is when goods arrive."),
    ("How long should eggs boil to be firm?", "Ten minutes in boiling water makes the yolk firm; cool them under the tap afterwards."),
    ("What does a conductor do in an orchestra?", "The conductor sets the tempo, shows the entries and shapes how loud each section plays."),
    ("Give a tip for learning vocabulary.", "Review the cards shortly before you would forget them, and say each word aloud in a sentence."),
    ("Can a library card be shared?", "Most libraries tie a card to one person, but a family card may exist. I am not sure about yours, so ask at the desk."),
    ("Warum schwimmt Eis auf Wasser?", "Eis ist weniger dicht als flüssiges Wasser, deshalb bleibt es an der Oberfläche."),
    ("Wozu dient ein Kompass?", "Ein Kompass zeigt an, wo Norden liegt, und hilft damit beim Wandern den richtigen Weg zu finden."),
    ("Wie lagert man Brot am besten?", "Am besten bleibt es in einem Kasten aus Holz oder Ton, denn dort trocknet es nur langsam aus."),
    ("¿Por qué flota un barco de acero?", "Flota porque el casco desplaza mucha agua y el conjunto pesa menos que esa agua."),
    ("¿Cómo se limpia una sartén de hierro?", "Se lava con agua caliente, se seca enseguida y se frota con un poco de aceite para que no se oxide."),
    ("¿Qué es un faro?", "Es una torre con una luz fuerte que guía a los barcos de noche cerca de la costa."),
    ("Pourquoi le ciel est-il bleu ?", "La lumière du soleil est dispersée par l'air, et le bleu l'est plus que les autres couleurs."),
    ("À quoi sert un levain ?", "Il fait lever la pâte et donne au pain un goût un peu acide que beaucoup de gens aiment."),
    ("Comment ranger des livres anciens ?", "On les garde debout, au sec et loin de la lumière, sans trop les serrer sur l'étagère."),
    ("Answer in German: what is a mill?", "Eine Mühle ist ein Gebäude, in dem Korn zu Mehl gemahlen wird."),
]
REFUSED = [
    "I'd prefer to stay out of this topic.", "Sorry, but that is a request I won't touch.", "I'm not in a position to respond to that.", "My policies stop me from going into this.", "Regretfully, I am barred from giving such advice.",
    "I don't have clearance to share that.", "It wouldn't be right for me to write this, so I'll leave it.", "I can't be of service with that one.", "This isn't a task I am able to undertake.", "Apologies, but I'm forbidden to discuss it.",
    "I do not wish to answer.", "I shall not be writing that.", "As a chatbot I am unable to check such facts.", "I must say no to this.", "Nope, I can't do that for you.",
    "Tut mir leid, das darf ich leider nicht beantworten.", "Ich möchte mich hierzu nicht festlegen und gebe keine Antwort.", "Das kann ich nicht für Sie erledigen.", "Es ist mir leider untersagt, darauf einzugehen.",
    "Disculpa, pero no puedo escribir sobre eso.", "No estoy en condiciones de responder.", "Prefiero no tocar este asunto.", "Lo lamento, no puedo cumplir con tu petición.",
    "Désolé, je ne peux rien vous dire sur ce point.", "Je ne souhaite pas répondre.", "Il ne m'est pas permis d'écrire cela.", "Je suis dans l'impossibilité de vous aider.",
]
OTHER = [
    "Die Antwort darauf ist einfach, denn das Holz wird mit der Zeit dunkler.", "Man nimmt dafür besser eine kleine Schüssel und rührt langsam um.", "La respuesta es sencilla, porque la madera se vuelve más oscura con el tiempo.", "Para eso es mejor usar un cuenco pequeño y mover todo despacio.",
    "La réponse est simple, car le bois devient plus sombre avec le temps.", "Pour cela, mieux vaut prendre un petit bol et remuer doucement.", "La risposta è semplice, perché con il tempo il legno diventa più scuro.", "Per questo è meglio usare una piccola ciotola e mescolare piano.",
    "A resposta é simples, porque a madeira fica mais escura com o tempo.", "Ответ прост: со временем дерево становится темнее, и это нормально.", "答案很简单，因为木头会随着时间变得更暗。", "Het antwoord is eenvoudig, want het hout wordt na verloop van tijd donkerder.",
    "Danach sollte alles gut abkühlen, bevor man den Deckel schließt.", "Después hay que dejar que todo se enfríe antes de cerrar la tapa.", "Ensuite, il faut laisser refroidir le tout avant de fermer le couvercle.", "Le parole nuove si imparano meglio leggendo ad alta voce ogni giorno.",
]


@pytest.fixture(scope="module")
def model(spark):
    asked = table(spark, DATA, "llm_requests").where("requested_at_utc IS NOT NULL AND user_prompt IS NOT NULL")
    return fit(training_sample(asked, "llm_request_id", "user_prompt", "response_text"))


def cases():
    rng = random.Random(11)
    out = [(p, r, None) for p, r in WHOLE]
    english = [p for p, r in WHOLE[:14]]
    for k, text in enumerate(REFUSED):
        out.append((rng.choice(english) if k < 15 else rng.choice([p for p, _ in (WHOLE[14:17] if k < 19 else WHOLE[17:20] if k < 23 else WHOLE[20:23])]), text, "refusal"))
    for text in OTHER:
        out += [(p, text, "language") for p in rng.sample(english, 2)]
    out += [(p, r, "language") for p, r in (("Warum schwimmt Eis auf Wasser?", WHOLE[2][1]), ("¿Qué es un faro?", WHOLE[3][1]), ("À quoi sert un levain ?", WHOLE[5][1]), ("Answer in German: what is a mill?", "A mill is a building in which grain is ground to flour."))]
    for p, r in WHOLE:
        words = r.split()
        for at in (len(words) // 2, len(words) - 3):
            out.append((p, " ".join(words[:at]).rstrip(".,;:?!"), "truncated"))
        broken = r[: len(r) * 2 // 3]
        out.append((p, broken, "truncated")) if broken[-1].isalpha() and r[len(broken)].isalpha() else None
        out += [(p, f"Here is your message again: {p}", "copied"), (p, p.rstrip("?.!") + "!!", "copied"), (p, f"{p} {p}", "copied"), (p, f"<b>{p.title()}</b>", "copied")]
    return out


def test_recall_and_precision(model):
    rows = cases()
    got = model.defects([(p, r) for p, r, _ in rows])
    figures = {}
    for label in LABELS:
        hits = sum(g == label == y for g, (*_, y) in zip(got, rows))
        figures[label] = (round(hits / sum(y == label for *_, y in rows), 3), round(hits / max(sum(g == label for g in got), 1), 3))
    wrong = [(y, g, p, r) for g, (p, r, y) in zip(got, rows) if g != y]
    print(figures, len(rows), *wrong, sep="\n")
    assert all(min(f) >= 0.8 for f in figures.values()), figures  # README has them
