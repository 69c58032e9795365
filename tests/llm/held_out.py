"""Sentences with marked personal data, written apart from the ones the field learns from: other names, countries and wordings."""

MARKED = """[N:Björn Lindqvist] sent it.
Yesterday [N:Priya Raghunathan] asked for the file.
Phone [P:0151 23456789] and ask for the caretaker.
Passport no. [I:512345678] was handed in at the desk.
Please transfer the deposit to [I:DE89 3704 0044 0532 0130 00] today.
We delivered the piano to [S:12 Baker Crescent] on Monday.
The keynote was given by [N:Chinedu Okonkwo] before lunch.
After the match, [N:Katarzyna Zielińska] thanked the crowd.
You will find [N:Oluwaseun Adeyemi] in the second row.
[N:Søren Kjeldsen] painted this wall in 1994.
A parcel for [N:Thandiwe Nkosi] waits at the counter.
The jury praised [N:Giovanni Bellandi] and [N:Marta Pellegrino].
The plumber, [N:Declan Murphy], fixed the boiler.
Write to [E:t.nkosi@postbox.example] with any concerns.
My new address is [E:lars_holm88@fjordmail.example].
Mail goes to [E:ana.souza+news@correio.example] only.
The clinic answers on [P:+46 8 123 456 78] until noon.
Her mobile is [P:+55 11 91234-5678] in the daytime.
Dial [P:(415) 555-2671] for the front desk.
Fax: [P:+44 161 496 0018]
The keys are at [S:48 Harrowgate Terrace, Millbrook].
He moved to [S:221 Juniper Drive, Fairhaven 60412] in June.
National insurance number [I:JK 48 21 93 B] is on the slip.
Her social security number, [I:527-44-9012], was leaked.
Driver licence [I:D4839201] had been revoked.
Herr [N:Cem Yıldırım] hat den Schlüssel verloren.
Am Abend las [N:Friederike von Ahlen] aus ihrem Roman.
Der Brief an [N:Wiebke Harmsen] kam zurück.
Meine Handynummer: [P:0176 55512345]
Besuchen Sie uns in der [S:Lindenstraße 14, 50674 Köln].
Wir treffen uns am [S:Mühlweg 7].
Der Personalausweis [I:T22000129] ist abgelaufen.
Monsieur [N:Abdoulaye Traoré] arrive demain matin.
Le médecin, [N:Solange Petitjean], a signé.
Appelez le [P:06 12 34 56 78] pour réserver.
Nous habitons [S:27 rue des Lilas, 69003 Lyon].
El fontanero [N:Íñigo Etxeberria] llegó tarde.
La alcaldesa, [N:Rosalía Montero], cortó la cinta.
Mi teléfono es [P:655 43 21 09] por la tarde.
Su DNI es [I:44718293-K] según el acta.
Vivo en [S:Calle Alcalá 52] desde enero.
Слесарь [N:Тимур Галиев] починил замок.
Вчера [N:Марина Хохлова] уехала в Казань.
Звоните по номеру [P:+7 916 555-12-34] днём.
Офис находится по адресу [S:ул. Гагарина, д. 12, кв. 5].
Паспорт [I:4510 123456] выдан в Туле.
Лікарка [N:Соломія Гнатюк] приймає у вівторок.
Мій номер [P:+380 67 123 45 67], дзвоніть.
联系人：[N:陈晓明]，请回电。
昨日、[N:高橋 健太]さんが来ました。
السيد [N:يوسف الخطيب] في الاجتماع.
डॉ. [N:कविता शर्मा] कल आएँगी।
คุณ[N:มาลี ศรีสุข] โทรมา
The Municipal Swimming Pool stays shut until May.
Order number 20931-448 left the warehouse on 03/12/2021.
The Golden Lion Brewery sponsors the Spring Festival.
Chapter 4 covers the Great Northern Railway and its bridges.
Version 12.4.1 needs 2048 MB of memory.
Die Stadtwerke und das Finanzamt bleiben geschlossen.
Rechnungsnummer 884210-77 ist noch offen.
Le Musée National et le Vieux Port attirent du monde.
La Plaza Mayor estaba vacía a las 9.
Книга вышла в издательстве тиражом 15000 экземпляров.
ISBN 978-3-16-148410-0 is listed twice.
The bill came to 1,204.50 and the tip to 180.""".splitlines()


def unmarked(line):
    """(text, spans): spans of (start, end, kind)."""
    import re

    kinds = {"E": 0, "P": 1, "I": 2, "S": 3, "N": 4}
    text, gold, at = "", set(), 0
    for m in re.finditer(r"\[([EPISN]):([^\]]*)\]", line):
        text += line[at : m.start()]
        gold.add((len(text), len(text) + len(m.group(2)), kinds[m.group(1)]))
        text += m.group(2)
        at = m.end()
    return text + line[at:], gold
