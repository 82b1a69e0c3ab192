import pytest

from docsift.llm import personal

# fmt: off
#: Sentences of other forms than those of the test tables. The scores were adjusted on these; before, recall was 0.81, precision 0.88.
ADJUSTED_ON = [
    ("we met Priya Raghunathan and her colleague Oluwaseun Adeyemi on Friday", [("person_name", "Priya Raghunathan"),("person_name", "Oluwaseun Adeyemi")]),
    ("the letter was written out by Margaret Thornton last week", [("person_name", "Margaret Thornton")]),
    ("Contact number 9876543210 for the delivery", [("phone", "9876543210")]),
    ("Reach us on 020 7946 0958 in the morning", [("phone", "020 7946 0958")]),
    ("She moved into 14 Rose Street, Pune 411001 last year.", [("street_address", "14 Rose Street, Pune 411001")]),
    ("Her old flat at Flat 7, 31 Birch Lane, Oxford was sold by Daniel Okafor.", [("street_address", "Flat 7, 31 Birch Lane, Oxford"),("person_name", "Daniel Okafor")]),
    ("My card 4539 5787 6362 1486 was charged twice", [("id_number", "4539 5787 6362 1486")]),
    ("Order 4539 5787 6362 1487 left the depot", []),
    ("Please pay into GB82 WEST 1234 5698 7654 32 by Monday", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
    ("Please pay into GB83 WEST 1234 5698 7654 32 by Monday", []),
    ("You may write to jane.doe@mail.example or to the shop", [("email", "jane.doe@mail.example")]),
    ("I spoke with Dr. Amara Nwosu about the Purchase Order", [("person_name", "Amara Nwosu")]),
    ("The tenant, Ivan Petrov, lives at 9 Castle Road, Leeds 44021 and pays late", [("person_name", "Ivan Petrov"),("street_address", "9 Castle Road, Leeds 44021")]),
    ("Hello Robert Finch, your parcel waits at Gate 4, Town Hall", [("person_name", "Robert Finch")]),
    ("Call me at +49 30 1234567 after work", [("phone", "+49 30 1234567")]),
    ("Her social security number is 123-45-6789 and nothing else", [("id_number", "123-45-6789")]),
    ("Reference 123-45-6789 was closed in March", []),
    ("Copy to Harlow Textile Mills and to Benson Freight Services", []),
    ("Kenji Watanabe signed the receipt for 12 pallets", [("person_name", "Kenji Watanabe")]),
    ("The van parked in 5 Elm Court overnight", [("street_address", "5 Elm Court")]),
    ("It takes place in 14 days at the Head Office", []),
    ("Passport K1234567 belongs to Lucia Moretti", [("id_number", "K1234567"),("person_name", "Lucia Moretti")]),
    ("Our neighbours Sarah Lindqvist and Tomas Berg complained", [("person_name", "Sarah Lindqvist"),("person_name", "Tomas Berg")]),
    ("Ask for Emily at the counter", []),
    ("Text us on 07700 900123 or e-mail sales (at) shop.example", [("phone", "07700 900123"),("email", "sales (at) shop.example")]),
    ("The Annual Report of the Regional Warehouse was approved", []),
    ("Goods were handed over to Fatima Al-Sayed at noon", [("person_name", "Fatima Al-Sayed")]),
    ("Deliver it to 221 Baker Street, London, please", [("street_address", "221 Baker Street, London")]),
]

#: Sentences that were written afterwards and that nothing was adjusted on.
FRESH = [
    ("The keys were left with Ngozi Balogun at reception", [("person_name", "Ngozi Balogun")]),
    ("Marek Dvorak called twice about the broken seal", [("person_name", "Marek Dvorak")]),
    ("We posted the cheque to 88 Orchard Avenue, Bristol 50213 in May", [("street_address", "88 Orchard Avenue, Bristol 50213")]),
    ("Her mobile is 07911 123456, but she prefers mail to h.lee@post.example", [("phone", "07911 123456"),("email", "h.lee@post.example")]),
    ("Charge 5555 5555 5555 4444 once more", [("id_number", "5555 5555 5555 4444")]),
    ("Batch 5555 5555 5555 4445 was scrapped", []),
    ("The refund goes to DE89 3704 0044 0532 0130 00 on Tuesday", [("id_number", "DE89 3704 0044 0532 0130 00")]),
    ("Taxpayer card ABCDE1234F was shown by Hiroshi Tanaka", [("id_number", "ABCDE1234F"),("person_name", "Hiroshi Tanaka")]),
    ("Thanks to Elena Marchetti for the quick reply", [("person_name", "Elena Marchetti")]),
    ("Dear William, the pallets are ready", [("person_name", "William")]),
    ("Mrs. Adaeze Obi lived in 3/41 Garden Terrace, Dover", [("person_name", "Adaeze Obi"),("street_address", "3/41 Garden Terrace, Dover")]),
    ("Signed by Pavel Novak, witness", [("person_name", "Pavel Novak")]),
    ("The Northern Branch ordered 400 units from Keller Machinery", []),
    ("Invoice 2023 7946 0958 is overdue since Monday", []),
    ("Dial +1 212 555 0188 for the front desk", [("phone", "+1 212 555 0188")]),
    ("His colleague Samuel Grant will call back", [("person_name", "Samuel Grant")]),
    ("Passport no. X12345678 expired", [("id_number", "X12345678")]),
    ("Collect it from Suite 12, 60 Quay Road, Hull 73301 after noon", [("street_address", "Suite 12, 60 Quay Road, Hull 73301")]),
    ("The Grand Total includes Value Added Tax", []),
    ("I told Leila Haddad and Jonas Weber about the delay", [("person_name", "Leila Haddad"),("person_name", "Jonas Weber")]),
]
# fmt: on


def rates(cases):
    found = [({(s.kind, t[s.start : s.end]) for s in personal.spans(t)}, set(want)) for t, want in cases]
    both = sum(len(g & w) for g, w in found)
    return both / sum(len(w) for _, w in found), both / sum(len(g) for g, _ in found)


def test_sentences_of_other_forms():
    assert rates(ADJUSTED_ON) == (1.0, 1.0)
    recall, precision = rates(FRESH)
    assert recall >= 0.9 and precision >= 0.9


@pytest.mark.parametrize("before", ["proof of identity: ", "national id: ", "we saw ", "order ", ""])
def test_checksums_decide(before):
    for number, valid in (("4539578763621486", True), ("4539578763621487", False), ("GB82 WEST 1234 5698 7654 32", True), ("GB83 WEST 1234 5698 7654 32", False)):
        got = [s.kind for s in personal.spans(before + number + " again")]
        assert got == (["id_number"] if valid and before != "order " else [])


def test_lines_that_are_no_address_as_a_whole():
    text = "She moved into 14 Rose Street, Pune 411001 last year.\n9 Castle Road, Leeds 44021\nthe move takes place in 14 days\n" + "x " * 300 + "\nflat 3, 12 elm court, leeds 44021"
    got = [text[s.start : s.end] for s in personal.spans(text)]
    assert got == ["14 Rose Street, Pune 411001", "9 Castle Road, Leeds 44021", "flat 3, 12 elm court, leeds 44021"]


def test_long_lines_and_names_are_read_whole():
    name = "Maximilian Wolfeschlegelsteinhausenbergerdorffwelchevoralternwarengewissenhaft"
    assert [s.kind for s in personal.spans("word " * 2_000 + f"it was signed by {name}")] == ["person_name"]
    assert personal.spans(f"{name}\nTAX INVOICE")[0].end == len(name)
