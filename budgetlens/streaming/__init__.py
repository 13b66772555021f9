"""budgetlens.streaming"""
